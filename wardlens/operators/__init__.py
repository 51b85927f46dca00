"""DataFrame operators the cohort queries, datasets, features and reports are composed of."""
