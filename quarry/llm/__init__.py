"""Operators for preparing training text: near-duplicates, token counts,
licences, decontamination, archives, page text, url rules, byte-level BPE,
quality rules and personal data. Nothing else in the library imports this."""
