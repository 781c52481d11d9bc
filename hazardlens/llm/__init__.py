"""Operators for preparing training text: filters, joins on near copies, language models, archives, mixing."""
