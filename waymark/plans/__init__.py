"""Request-level plans: the engine and its tuner."""
