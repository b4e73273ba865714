"""Plans that iterate: values of learning paths, and the cascade of extraction strategies."""
