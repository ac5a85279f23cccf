"""The registered queries of this package and their SQL."""

from __future__ import annotations

from studiolake.llm import chat, decontaminate, langid, lm, maxscore, minhash, mixing, periodic, pii, quality, tokens, trie, urls

MODULES = [tokens, mixing, quality, decontaminate, langid, minhash, urls, chat, lm, pii, periodic, trie, maxscore]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
