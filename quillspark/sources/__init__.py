"""Where documents come from and where results go."""
