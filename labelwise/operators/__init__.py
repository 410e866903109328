"""DataFrame operators: preparation, encoding, sampling, evaluation, vector math, training, encoders."""
