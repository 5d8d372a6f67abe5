"""Training-data operators: archives, classifiers, near-duplicates, decontamination, sharding, URL rules, tokens."""
