"""Training-data operators: tokenizing, packing, de-duplication, quality, personal data, media and archives."""
