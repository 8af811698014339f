"""Scripted providers that the queries and tests call in the place of paid models."""

from __future__ import annotations

import hashlib

import numpy as np


class SeededEmbedder:
    """Unit vectors drawn from a generator that the text's SHA-256 seeds."""

    model = "seeded"

    def __init__(self, dims: int = 16):
        self.dims = dims

    def run(self, texts: list[str]) -> list[list[float]]:
        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts]
        drawn = [np.random.default_rng(s).standard_normal(self.dims) for s in seeds]
        return [(v / np.linalg.norm(v)).tolist() for v in drawn]


class KeywordSummariser:
    """The first words of a text, and junk by keyword; texts with ``fail`` fail."""

    model = "keyword"

    def run(self, texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            if "fail" in text:
                raise RuntimeError("scripted failure")
            junk = "newsletter" if "unsubscribe" in text.lower() else "none"
            out.append({"issue": " ".join(text.split()[:8]) or "nothing", "junk_type": junk})
        return out


class KeywordLabeller:
    """The most frequent long word of the texts, the first by letters of equal ones; topics with the text ``refused`` fail."""

    def __init__(self, refused: str | None = None):
        self.refused = refused

    def run(self, texts: list[str]) -> dict:
        if self.refused in texts:
            raise RuntimeError("scripted failure")
        words = [w for t in texts for w in t.lower().split() if len(w) > 4]
        top = max(sorted(set(words)), key=words.count) if words else "empty"
        usage = {"prompt_tokens": sum(map(len, texts)), "completion_tokens": 3}  # a token is a character of the texts, a word of the label
        return {"label": f"about {top} texts", "coherent": bool(words), "usage": usage}
