"""All registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from quarry.plans import chat_views, documents, vectors, web_pages

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (documents, chat_views, vectors, web_pages):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
