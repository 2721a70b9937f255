"""Operators for preparing large training collections; nothing else in kartei imports this."""
