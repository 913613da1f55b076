"""Training-data operators: filtering, de-duplication, packing, scoring and token encoding of large text corpora."""
