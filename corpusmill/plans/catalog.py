"""Every query of the library by name, with its SQL."""

from . import chunks, domain, relational, retrieval, texts

_PARTS = (retrieval, texts, domain, chunks, relational)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
