"""Pure Column -> Column functions."""
