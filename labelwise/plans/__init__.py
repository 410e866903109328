"""Composed runs (training epochs, grids) and the registry of checked queries."""
