"""Training-data operators: token files, licences, chat windows, near-duplicates, packing, URLs, BPE, quality."""
