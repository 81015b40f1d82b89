"""Training-data operators: LM scoring, secret scans, quality rules, token counts, ANN search, set joins,
language ID, packing, source mixing and token-ID output. Nothing outside this folder imports it."""
