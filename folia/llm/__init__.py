"""Training-data preparation operators (language, toxicity, secrets, archives, packing, overlap, quality, privacy)."""
