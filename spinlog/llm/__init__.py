"""Training-data operators: token files, decontamination, duplicates, personal data, classifiers, search."""
