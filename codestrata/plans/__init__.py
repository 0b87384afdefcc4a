"""User-level jobs put together from operators."""
