"""Operators on language-model text; nothing outside this subpackage imports it."""
