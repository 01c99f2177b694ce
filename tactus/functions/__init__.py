"""Part of tactus; see README.md."""
