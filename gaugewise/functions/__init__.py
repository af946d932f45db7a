"""Column helpers with the numeric conventions of the screening rules."""
