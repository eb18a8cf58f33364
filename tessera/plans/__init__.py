"""Registered queries over the standard tables; importing this registers them."""

from . import answers, authority, entities, evidence, identity, more, ops, research, rest, search, serving, stores, texts, understanding  # noqa: F401
