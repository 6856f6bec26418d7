from .scoring import row_local_features, score_stream  # noqa: F401
