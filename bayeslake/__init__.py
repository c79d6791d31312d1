"""Bayesian-network parameter learning and classification on Spark DataFrames.

    model = fit(train_df, [("a", "label"), ("x", "label")])
    scored = predict(model, test_df, "label", default_prob=1e-5)
"""

from .operators.fit import Model, fit
from .operators.metrics import accuracy, confusion, per_label
from .operators.predict import candidate_scores, node_factor, predict, predict_with_labels
from .plans.dag import CONTINUOUS, DISCRETE, Network, NetworkError, fan_in_edges
from .sources.tables import (csv_round_trip, encode_codes, read_csv_infer, split_key,
                             split_random, standardize)

__all__ = ["Model", "fit", "predict", "predict_with_labels", "candidate_scores", "node_factor",
           "accuracy", "confusion", "per_label", "Network", "NetworkError", "fan_in_edges",
           "DISCRETE", "CONTINUOUS", "encode_codes", "standardize", "split_key", "split_random",
           "csv_round_trip", "read_csv_infer"]
