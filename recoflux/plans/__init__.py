"""Models, evaluation and tuning."""
