"""Encodings of bytes by likelihood: a model of characters per encoding, its logarithms added up over chunks.

An encoding is used for some languages, and these use few of the characters it has. Each model gives every character the share of its kind
(kana, common ideographs, letters, marks of a code page, controls, ...) divided by the number of characters of that kind. Bytes of one
encoding read as another come out as characters that the other's languages hardly use, or do not decode at all. Sums over chunks of
one file add up to the sum over the file, so chunks can be scored by different tasks.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Encodings without a mark that are told apart, in order of preference among equals.
CANDIDATES = (
    "latin-1", "windows-1252", "utf-16le", "utf-16be", "gb18030", "shift_jis", "euc-jp", "euc-kr",
)
#: Shares of the kinds of characters in texts that are written in an encoding. What is left goes to all other characters.
_SHARES = {
    "western": {"blank": 0.15, "letter": 0.74, "digit": 0.03, "mark": 0.04, "accented": 0.035, "quote": 0.002, "sign": 0.001},
    "chinese": {"blank": 0.02, "letter": 0.05, "digit": 0.03, "mark": 0.02, "wide": 0.1, "common_hanzi": 0.36, "rare_hanzi": 0.04, "kana": 0.003,
                "frequent_hanzi": 0.36},
    "japanese": {"blank": 0.01, "letter": 0.04, "digit": 0.03, "mark": 0.02, "wide": 0.1, "hiragana": 0.42, "katakana": 0.1,
                 "common_kanji": 0.14, "rare_kanji": 0.005, "half_kana": 0.001, "frequent_kanji": 0.12},
    "korean": {"blank": 0.15, "letter": 0.04, "digit": 0.03, "mark": 0.04, "wide": 0.01, "hangul": 0.26, "hanja": 0.01,
               "frequent_hangul": 0.45},
    "any": {"blank": 0.12, "letter": 0.5, "digit": 0.03, "mark": 0.04, "accented": 0.03, "wide": 0.02, "hiragana": 0.05, "katakana": 0.01,
            "common_hanzi": 0.08, "hangul": 0.05, "quote": 0.002},
}
_LANGUAGES = {
    "latin-1": "western", "windows-1252": "western", "utf-16le": "any", "utf-16be": "any", "gb18030": "chinese", "shift_jis": "japanese",
    "euc-jp": "japanese", "euc-kr": "korean",
}
#: Fixed values, most frequent first: the characters that make up about half of running text in Chinese and of the kanji in Japanese, and
#: more in Korean. The codes of common characters of one language are those of common ones of another, but seldom those of its most
#: frequent. Their shares fall with their rank, as 1 / (9 + rank).
_FREQUENT_HANZI = (
    "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去"
    "法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点"
)
_FREQUENT_KANJI = (
    "日一国会人年大十二本中長出三同時政事自行社見月分議後前民生連五発間対上部東者党地合市業内相方四定今回新場金員九入選立開手米力学"
    "問高代明実円関決子動京全目表戦経通外最言氏現理調体化田当八六約主題下首意法不来作性的要用制治度務強気小七成期公持野協取都和"
)
_FREQUENT_HANGUL = (
    "이다는을가에의고하지도로한기나사아대리서자인시어그해은를들으정일니수게있것라전보스과여부만주제상장구말원면적성조었없우안내모무세러오공"
    "거려히동요트경소생비때치와간마되중문했관용선화신년방국던물음같였계연위실드미학회교합발개재분산영명유단반결"
)
#: Bytes decoded at a time.
CHUNK = 1 << 20
_POINTS = 0x10000


def _rows(codec: str, first: int, last: int) -> np.ndarray:
    """Code points of a range of rows of a code table of 94 columns, by its two-byte form."""
    text = b"".join(bytes((lead, trail)) for lead in range(0xA0 + first, 0xA1 + last) for trail in range(0xA1, 0xFF)).decode(codec, "ignore")
    points = np.array(sorted({ord(c) for c in text}))
    return points[points < _POINTS]


def _points(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text])


@lru_cache(1)
def _kinds() -> dict[str, np.ndarray]:
    """Code points of each kind; where kinds overlap within a language, the later one counts."""
    span = np.arange
    quotes = bytes(b for b in range(0x80, 0xA0)).decode("windows-1252", "ignore")
    return {
        "blank": np.array([9, 10, 13, 32]), "letter": np.r_[span(65, 91), span(97, 123)], "digit": span(48, 58),
        "mark": np.r_[span(33, 48), span(58, 65), span(91, 97), span(123, 127)], "sign": span(0xA0, 0xC0),
        "accented": np.setdiff1d(span(0xC0, 0x100), [0xD7, 0xF7]), "quote": _points(quotes),
        "wide": np.r_[span(0x3000, 0x3018), span(0xFF01, 0xFF60)], "kana": span(0x3041, 0x30FF), "hiragana": span(0x3041, 0x3094),
        "katakana": np.r_[span(0x30A1, 0x30FF)], "half_kana": span(0xFF61, 0xFFA0),
        # Code tables put the common ideographs of their language into a first level of rows.
        "common_hanzi": _rows("gb2312", 16, 55), "rare_hanzi": _rows("gb2312", 56, 87),
        "common_kanji": _rows("euc-jp", 16, 47), "rare_kanji": _rows("euc-jp", 48, 84),
        "hangul": _rows("euc-kr", 16, 40), "hanja": _rows("euc-kr", 42, 93),
        "frequent_hanzi": _points(_FREQUENT_HANZI), "frequent_kanji": _points(_FREQUENT_KANJI),
        "frequent_hangul": _points(_FREQUENT_HANGUL),
    }


@lru_cache(None)
def _weights(language: str) -> np.ndarray:
    """Logarithm of the probability of each code point of the first plane; controls are a thousand times rarer than the rest."""
    shares = _SHARES[language]
    out = np.full(_POINTS, math.log((1 - sum(shares.values())) / 30_000))
    out[np.r_[0:9, 11:13, 14:32, 127:160]] -= math.log(1000)
    out[0xD800:0xF900] -= math.log(1000)
    for kind, share in shares.items():
        points = _kinds()[kind]
        parts = 1 / (10 + np.arange(len(points))) if kind.startswith("frequent_") else np.ones(len(points))
        out[points] = np.log(share * parts / parts.sum())
    return out


def _pieces(content: bytes) -> Iterator[bytes]:
    for at in range(0, len(content), CHUNK):
        yield content[at : at + CHUNK]


def log_likelihoods(content: bytes) -> list[float | None]:
    """The logarithm of the probability of ``content`` under each of ``CANDIDATES``; null where it does not decode.

    Contents are decoded chunk by chunk, so a large one takes little memory. Empty content has 0 everywhere.
    """
    return [_log_likelihood(content, name) for name in CANDIDATES]


def _log_likelihood(content: bytes, name: str) -> float | None:
    decoder, weights, total = codecs.getincrementaldecoder(name)("strict"), _weights(_LANGUAGES[name]), 0.0
    try:
        for piece in _pieces(content):
            total += _sum(decoder.decode(piece), weights)
        return total + _sum(decoder.decode(b"", True), weights)
    except UnicodeError:
        return None


def _sum(text: str, weights: np.ndarray) -> float:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = points[points < _POINTS]
    return float(weights[known].sum()) + (len(points) - len(known)) * float(weights.min())


def most_likely(sums: list[float | None]) -> str:
    """The best of ``CANDIDATES`` by their sums, the first among equals; Latin-1, which decodes anything, if there is none."""
    best = max((s for s in sums if s is not None), default=None)
    return next((n for n, s in zip(CANDIDATES, sums, strict=True) if s is not None and s == best), CANDIDATES[0])
