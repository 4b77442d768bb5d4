"""Field analytics on Spark."""

from fluxmesh.plans import registry  # noqa: F401  first, so that its modules can be imported in any order
