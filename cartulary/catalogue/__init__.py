"""The catalogue's own rules: observations to candidates to publications."""
