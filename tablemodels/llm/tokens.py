"""Exact ids of a ``tokenizers`` file at the speed of a word table.

A public BPE file works on one pre-token at a time and never joins text across
``" x"`` (a space before a non-space), so a text falls apart there and each
piece is encoded once per worker. A piece of letters, punctuation and single
line breaks falls apart further. Whatever these rules do not cover is encoded
as it stands.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

from tablemodels.llm.common import per_worker

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but for the apostrophe, which starts contractions
_PLAIN = re.compile(rf"[{LETTERS}{MARKS}](?:[{LETTERS}{MARKS}]|\n(?=[{LETTERS}{MARKS}]))*")
_RUNS = re.compile(rf"[{LETTERS}]+|[{MARKS}]+|\n")
_UNSAFE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
LONGEST_KEPT = 64
ENTRIES = 300_000
SLICE_CHARS = 1_000_000


def slices(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters, each but the first starting with ``" x"``."""
    start = 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def pieces(text: str) -> list[str]:
    """Parts of a text between which no token reaches; all but the first have lost a leading space."""
    return _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


class _Kept(dict):
    """Two generations of remembered values; the older one is dropped when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """``ids_bytes(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as
    little-endian unsigned 32-bit integers; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.lower = self.normalizer is not None and self.normalizer.normalize_str("Aé") == "aé"
        before = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0]
        self.space = before.removesuffix("a")  # what is left of a space in front of a word
        whole = ByteLevel(add_prefix_space=False, use_regex=False)
        # Characters that stand for bytes; every byte is printed as one character.
        self.printed = {b: whole.pre_tokenize_str(chr(b))[0][0][-1] for b in range(128)}
        self.printed |= {b: whole.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1] for b in range(128, 192)}
        self.printed |= {0xC3: whole.pre_tokenize_str("é")[0][0][0]}
        self.plain = (self.normalizer is None or self.lower) and before in ("a", self.printed[32] + "a")
        self.runs = _Kept(self._run)
        self.words = _Kept(self._word)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, text: str) -> bytes:
        """One run of letters or marks is one pre-token and goes straight to the model."""
        if not self.plain or text[-1] == "\n":
            return self._whole(text)
        word = text.lower() if self.lower else text
        lead = ""
        if word[0] == " ":
            lead, word = self.space, word[1:]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.printed)
        ids = [t.id for t in self.model.tokenize(lead + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT or not _PLAIN.fullmatch(word):
            return self._whole(" " + word)
        runs = _RUNS.findall(word)
        runs[0] = " " + runs[0]
        return b"".join(map(self.runs.__getitem__, runs))

    def ids_bytes(self, text: str | None) -> bytes:
        out = []
        for part in slices(text or ""):
            first, *rest = pieces(part)
            out.append(self._whole(first) if first else b"")
            out.extend(map(self.words.__getitem__, rest))
        return b"".join(out)


def printed_bytes() -> dict[str, int]:
    """What byte-level vocabularies print for each byte: itself if visible, else the next character from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


# Fixed value: the pre-token pattern of the byte-level vocabulary files.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


class RankEncoder:
    """The ids of a byte-level file whose ids rise with the order of its merges, by a merge table of bytes.

    Several times faster than a word table where words hardly repeat. Long runs
    without a break, on which merging by rank takes quadratic time, go to the
    file's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        ranks = {b: i for i, b in self.spelt().items()}
        self.merges = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def spelt(self) -> dict[int, bytes]:
        """Bytes of every ordinary id."""
        with open(self.path, encoding="utf-8") as file:
            held = json.load(file)
        printed, special = printed_bytes(), {t["id"] for t in held.get("added_tokens", ())}
        vocabulary = held["model"]["vocab"].items()
        return {i: bytes(printed[c] for c in s) for s, i in vocabulary if i not in special and all(c in printed for c in s)}

    @cached_property
    def tokenizer(self):
        """The file's own tokenizer; few texts need it, so few workers hold it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    def ids(self, text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.merges.encode_ordinary(text)


# What the public word file does to a text before it looks for tokens.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
_ALL_MARKS = r"!-/:-@\[-`{-~"
_SIMPLE = re.compile(rf"[{LETTERS}0-9{_ALL_MARKS} \n\t\r]*")
_MARKS_AND_DIGITS = re.compile(rf"('(?:[stmd]|re|ve|ll)|[{_ALL_MARKS}]+|[0-9])")
LONGEST_MERGED = 1000


class WordEndEncoder:
    """``ids_bytes(text)`` as of :class:`WordEncoder`, for the file of lower-case words with marked ends, by a merge table.

    No token holds white space, so a blank can stand for the mark of a word's
    end, which joins the last byte before any other merge, as in the file. The
    ids of short words are remembered. Words with other letters than those of
    ``_SIMPLE``, and very long ones, go to the file's own tokenizer, which few
    workers hold.
    """

    def __init__(self, path: str, held: dict):
        import tiktoken

        self.path = path
        printed, special = printed_bytes(), {t["id"] for t in held["added_tokens"]}
        ranks = {}
        for entry, i in held["model"]["vocab"].items():
            core = entry.removesuffix(WORD_END)
            if i not in special and printed.get(entry) == 0x20:
                ranks[b" "] = i  # never found alone
            elif i not in special and core:
                spelt = bytes(printed[c] for c in core)
                if b" " not in spelt:
                    ranks[spelt + b" " * (core != entry)] = i
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.kept = _Kept(self._word)

    @staticmethod
    def fits(held: dict) -> bool:
        """Whether a file has the rules that this class follows."""
        normalizer, cut = held.get("normalizer") or {}, held.get("pre_tokenizer") or {}
        model, steps = held["model"], cut.get("pretokenizers") or [{}]
        return (
            normalizer.get("normalizers") == WORD_NORMALIZERS
            and [k.get("type") for k in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        )

    @cached_property
    def words(self) -> WordEncoder:
        return WordEncoder(self.path)

    def _word(self, word: str) -> bytes:
        if len(word) > LONGEST_MERGED:
            return self.words.ids_bytes(word)
        ids = self.merges.encode_ordinary(word + " ")
        return struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, " ".join(_MARKS_AND_DIGITS.split(text.lower())).split()))

    def ids_bytes(self, text: str | None) -> bytes:
        out = []
        for part in slices(text or ""):
            if _SIMPLE.fullmatch(part):
                out.append(self._simple(part))
            else:
                for simple, run in groupby(part.split(" "), lambda w: _SIMPLE.fullmatch(w) is not None):
                    out.append((self._simple if simple else self.words.ids_bytes)(" ".join(run)))
        return b"".join(out)


def rank_encoder(path: str) -> RankEncoder:
    """One encoder per worker process and file."""
    return per_worker(("ranks", path), lambda: RankEncoder(path))


def encoder(path: str) -> WordEncoder | WordEndEncoder:
    """One encoder per worker process and file."""

    def made():
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        return WordEndEncoder(path, held) if WordEndEncoder.fits(held) else WordEncoder(path)

    return per_worker(("encoder", path), made)


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; called inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)
