"""DataFrame operators: each is ``DataFrame (+ parameters) -> DataFrame``."""
