"""Authored dimension data: rules, templates, guidance cards, word lists."""
