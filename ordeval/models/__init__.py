"""Train-only preprocessing, models and attributions."""
