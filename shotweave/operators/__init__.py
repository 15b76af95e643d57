"""DataFrame operators: labels, sampling, augmentation, mixing, assembly,
scoring, metrics, results and review tables."""
