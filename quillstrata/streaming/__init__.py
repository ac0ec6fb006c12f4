"""File-source streaming on top of the batch operators."""
