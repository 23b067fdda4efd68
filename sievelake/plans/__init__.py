"""Session helpers and plan-level utilities shared by all operators."""
