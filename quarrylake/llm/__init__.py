"""Operators on texts: tokenizing, packing, language identification. Nothing outside this package imports it."""
