from flightperf.functions import dims, exprs  # noqa: F401
