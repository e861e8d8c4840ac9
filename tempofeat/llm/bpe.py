"""Loading public tokenizer files: ids of whole texts, and of single pre-tokens."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

# Code points for which `regex` and the tokenizers library split alike (checked
# over all planes); a text with any other goes through the library as a whole.
_SPLITTABLE = "\x00-՗֐-ࢎऀ-౛‐-⁠　-鿿가-힣＀-￯"
# Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The engine's split runs out of stack in longer runs of white space; texts with one go through the library.
LONGEST_RUN = 100_000
_RUN = re.compile(r"\s+")


def beyond_engine(text: str) -> bool:
    """Whether the text has a run of white space that the merge engine cannot split."""
    return len(text) > LONGEST_RUN and any(len(run) > LONGEST_RUN for run in _RUN.findall(text))


def resolve(name: str) -> str:
    """The path of a tokenizer file: itself if absolute, else of the public set."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Token ids as the library of the file gives them, with no added begin or end.

    Byte-level BPE files whose merges are in the order of their ids run on the
    merge engine of tiktoken, whose ids are the same; all others on their library.
    """

    def __init__(self, name: str):
        path = resolve(name)
        self.engine = self.pattern = None
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library: Callable[[str], list[int]] = lambda text: piece.encode(text, num_threads=1)
            return
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = tokenizers.Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.library = lambda text: whole.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._fast(spec)

    def _fast(self, spec: dict) -> None:
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model.get("type") != "BPE"
            or spec.get("normalizer")
            or any(split.get(k) != v for k, v in plain.items())
            or any(model.get(k) for k in off)
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        ):
            return
        vocab, letters = model["vocab"], _byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(order):
            return
        import tiktoken

        special = {a["content"]: a["id"] for a in added}
        self.special = list(special)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.engine = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        self.pattern = BYTE_LEVEL

    def ids(self, text: str) -> list[int]:
        return self.engine.encode(text, allowed_special="all") if self.engine and not beyond_engine(text) else self.library(text)

    def piece_length(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.library(piece) if beyond_engine(piece) else self.engine.encode_ordinary(piece))

    def splitter(self) -> Callable[[str], list[str] | None] | None:
        """Pre-tokens of a text, or None for a text that must be encoded whole.

        None instead of a function where the file has no such split."""
        if not self.engine:
            return None
        import regex

        find, odd = regex.compile(self.pattern).findall, re.compile(f"[^{_SPLITTABLE}]").search
        special = self.special

        def split(text: str) -> list[str] | None:
            if any(s in text for s in special) or not text.isascii() and odd(text):
                return None
            return find(text)

        return split
