"""Table operators: profiling, ordering, sampling, features, models, images."""
