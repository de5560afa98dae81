"""Training-data operators: near and exact duplicates, language, quality, toxicity, LM scores,
tokenization, packing, vector search and chat rendering. Nothing outside this subpackage imports it."""
