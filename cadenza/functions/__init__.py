"""Part of cadenza; see README.md."""
