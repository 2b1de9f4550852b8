"""Quality rules with line labels: fixed counts, and a linear-chain conditional random field over a text's lines.

Each line with a word is content or boilerplate. A line's features are shares and sizes (words, symbols, capitals,
digits, bars, closing punctuation, repeats, a few telling words); the field adds what stands next to what, and Viterbi
decoding takes the likeliest labels of the whole text. A document is kept when no fixed rule fails and content lines hold
at least ``share`` of its characters. The field is trained here, by gradient descent on the exact likelihood
(forward-backward), from a small table of labelled line sequences; the driver fits it once and ships about 30 numbers.

Counts are taken from bytes in batches: words and lines are compared by 64-bit hashes of their bytes, per document.
A task holds one Arrow batch; a text is never cut.

Nulls: a missing text has no words (and fails the fixed rules); a missing doc_id stays missing. Texts without words
have no lines to label and are not kept. Equal rows get equal results, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import text_of

SHARE = 0.5
MIN_WORDS = 50
BATCH_BYTES = 1 << 20
SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Words that stand in navigation, notices and footers.
TELLING = (
    "cookie cookies privacy policy copyright rights reserved terms subscribe newsletter login sign menu home contact sitemap share tweet "
    "facebook advertisement sponsored comments previous next javascript browser click © accept register password cart checkout datenschutz "
    "impressum mentions légales accueil inicio aviso"
).split()

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = 0x9E3779B97F4A7C15
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


WHITE, SYMBOL, CAPITAL, DIGIT, CLOSING = _flags(b" \t\n\x0b\x0c\r"), _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(b"0123456789"), _flags(b".!?:;\"'")
LETTER = CAPITAL | _flags(bytes(range(97, 123))) | _flags(bytes(range(0xC2, 0xF5)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse modulo 2 ** 64, for i below n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, STEP, np.uint64), np.full(size, pow(STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum."""
    up, down = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * up[: len(data)])])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX[2]
    h ^= h >> np.uint64(31)
    h *= MIX[0]
    return h ^ (h >> np.uint64(29))


TELLING_HASHES = np.sort(np.concatenate([span_hashes(np.frombuffer((w + e).encode(), np.uint8), np.array([0]), np.array([len((w + e).encode())])) for w in TELLING for e in ("", ".", ",", ":", "!")]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _seen_again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it is found twice or more, and whether it is found earlier too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, earlier


FEATURES = 15


class Batch:
    """Counts of a batch of texts by document, and the features of their lines."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        doc_ends = np.cumsum([len(t) + 1 for t in texts])
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        white = WHITE[data]
        inside = ~white
        first = inside & np.concatenate([[True], white[:-1]])
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(white & np.concatenate([[False], inside[:-1]]))

        def counts(flags: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

        def between(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return c[b] - c[a]

        word_sum, char_sum, symbol_sum = counts(first), counts(inside & ((data & 0xC0) != 0x80)), counts(SYMBOL[data])
        self.n_words, self.word_chars, self.n_symbols = (between(c, doc_starts, doc_ends) for c in (word_sum, char_sum, symbol_sum))
        hashes = span_hashes(LOWER[data], starts, ends)
        telling = np.concatenate([[0], np.cumsum(np.isin(hashes, TELLING_HASHES), dtype=np.int64)])
        hashes = span_hashes(data, starts, ends)
        word_doc = np.repeat(np.arange(len(texts)), self.n_words)
        repeated = np.zeros(len(starts), bool)
        if len(starts) > 2:
            same_doc = word_doc[2:] == word_doc[:-2]
            three = hashes[:-2] * MIX[1] + hashes[1:-1] * MIX[2] + hashes[2:] * MIX[3]
            three = (three ^ (three >> np.uint64(32))) * MIX[0] + word_doc[:-2].astype(np.uint64) * MIX[3]
            at = np.flatnonzero(same_doc)
            found = at[_seen_again(three[at])[0]]
            for k in range(3):
                repeated[found + k] = True
        repeat_sum = np.concatenate([[0], np.cumsum(repeated, dtype=np.int64)])
        doc_words = np.concatenate([[0], np.cumsum(self.n_words)])
        self.n_repeat = repeat_sum[doc_words[1:]] - repeat_sum[doc_words[:-1]]
        # Lines with a word.
        line_ends = np.flatnonzero(data == 10)
        line_starts = np.concatenate([[0], line_ends[:-1] + 1])
        n = between(word_sum, line_starts, line_ends)
        line_starts, line_ends, n = line_starts[n > 0], line_ends[n > 0], n[n > 0]
        line_doc = np.searchsorted(doc_ends, line_starts, side="right")
        earlier = _seen_again(span_hashes(data, line_starts, line_ends) + line_doc.astype(np.uint64) * MIX[3])[1] if len(n) else np.zeros(0, bool)
        self.n_dup_lines = np.bincount(line_doc, earlier, len(texts)).astype(np.int64)
        self.lines_of = np.concatenate([[0], np.cumsum(np.bincount(line_doc, minlength=len(texts)))])
        self.line_chars = between(char_sum, line_starts, line_ends)
        at = word_sum[line_starts]
        chars = np.maximum(1, self.line_chars)
        letters = np.maximum(1, between(counts(LETTER[data]), line_starts, line_ends))
        last = data[ends[at + n - 1] - 1] if len(n) else np.zeros(0, np.uint8)
        self.features = np.column_stack(
            [
                np.ones(len(n)),
                n <= 2,
                (n > 2) & (n <= 5),
                (n > 5) & (n <= 12),
                n > 12,
                CLOSING[last],
                np.minimum(1, between(symbol_sum, line_starts, line_ends) / n),
                between(counts(CAPITAL[data]), line_starts, line_ends) / letters,
                between(counts(DIGIT[data]), line_starts, line_ends) / chars,
                np.minimum(1, between(counts(data == 124), line_starts, line_ends) / n * 2),
                np.minimum(1, (telling[at + n] - telling[at]) / n * 4),
                earlier,
                np.minimum(1, chars / n / 20),
                np.minimum(1, between(counts(data == 33), line_starts, line_ends) / n),
                (repeat_sum[at + n] - repeat_sum[at]) / n,
            ]
        )


# -- the field --------------------------------------------------------------------------------------------------


def _sequence_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of a sequence's log likelihood by forward-backward in log space."""
    u, n = x @ w, len(x)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = u[0]
    for i in range(1, n):
        f[i] = u[i] + np.logaddexp(f[i - 1, 0] + t[0], f[i - 1, 1] + t[1])
    for i in range(n - 2, -1, -1):
        v = u[i + 1] + b[i + 1]
        b[i] = np.logaddexp(t[:, 0] + v[0], t[:, 1] + v[1])
    z = np.logaddexp(*f[-1])
    p = np.exp(f + b - z)
    gw = x.T @ (np.eye(2)[y] - p)
    gt = np.zeros((2, 2))
    for i in range(1, n):
        gt[y[i - 1], y[i]] += 1
        gt -= np.exp(f[i - 1][:, None] + t + u[i] + b[i] - z)
    return gw, gt


def fit_field(labelled: list[tuple[list[str], list[int]]], steps: int = 300, rate: float = 1.0, ridge: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions (label, label) from sequences of lines with labels (1: content)."""
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    data = [(Batch(["\n".join(lines).encode()]).features, np.array(y)) for lines, y in labelled]
    total = sum(len(y) for _, y in data)
    for _ in range(steps):
        g = [_sequence_gradient(x, y, w, t) for x, y in data]
        w += rate * (sum(a for a, _ in g) / total - ridge * w)
        t += rate * (sum(b for _, b in g) / total - ridge * t)
    return w, t


def viterbi(scores: list[list[float]], t: list[list[float]]) -> list[int]:
    """Likeliest labels of a sequence of lines."""
    (t00, t01), (t10, t11) = t
    a0, a1 = scores[0]
    back = []
    for u0, u1 in scores[1:]:
        from0, from1 = a0 + t00 >= a1 + t10, a0 + t01 >= a1 + t11
        back.append((from0, from1))
        a0, a1 = u0 + (a0 + t00 if from0 else a1 + t10), u1 + (a0 + t01 if from1 else a1 + t11)
    label = int(a1 > a0)
    out = [label]
    for from0, from1 in reversed(back):
        label = 0 if (from1 if label else from0) else 1
        out.append(label)
    return out[::-1]


def labelled_lines() -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sequences of lines, 1 for content."""
    prose = [
        "The river had risen in the night, and by the morning the lower road was under water for nearly a mile.",
        "Nobody in the village could say how old the mill was, but its wheel had turned for as long as anyone knew.",
        "Die Brücke wurde im Frühjahr gebaut. Seitdem fahren die Züge jede Stunde über den Fluss.",
        "El mercado abre temprano y la gente llega con cestas, aunque a veces llueve toda la semana.",
        "Les enfants de l'école ont planté des arbres le long du chemin, puis ils sont rentrés à pied.",
        "Measurements were repeated on three days; the second series differed from the first by less than one part in a hundred.",
        "He wrote that the harvest was poor.",
        "It rained.",
        "So it was.",
        "Later that year, the council of the town agreed to repair the harbour wall and to build a light at its end, which was finished in 1874.",
    ]
    junk = [
        "Home | About | Contact | Login",
        "Products | Prices | Support | Jobs | Press | Terms",
        "red | green | stone, | river | plant. | copper | autumn | window | silver | candle | market | garden.",
        "Menu",
        "Share this",
        "We use cookies. Accept cookies or read our privacy policy.",
        "Copyright 2019. All rights reserved.",
        "Subscribe to our newsletter",
        "### $$$ %%% click here &&& now ***",
        "cheap### offer$$$ buy%%% now&&& today*** best### price$$$ here%%%",
        "BUY NOW!! BEST!! PRICE!! CALL!! TODAY!! OFFER!! ENDS!! SOON!!",
        "Previous | Next",
        "1 2 3 4 5 6 7 8 9",
        "12:30 | 14:05 | 17:45 | 19:10",
        "free free free free free free free free free free free free",
    ]
    # Long lines of lists, of signs and of capitals, from the words of the prose.
    words = " ".join(prose).replace(".", "").replace(",", "").split()
    for i in range(6):
        some = words[i * 17 : i * 17 + 30 + i * 5]
        junk.insert(i * 3, (" | ".join(some), " ".join(x + ("###", "$$$", "%%%", "&&&", "***")[len(x) % 5] for x in some), "!! ".join(x.upper() for x in some))[i % 3])
    junk += [line.rstrip("!.") + "." for line in junk]  # closing punctuation alone tells nothing
    out = []
    for i in range(30):
        p = [prose[(i * 3 + k) % len(prose)] for k in range(3 + i % 4)]
        j = [junk[(i * 5 + k) % len(junk)] for k in range(1 + i % 3)]
        k = [junk[(i * 7 + m + 3) % len(junk)] for m in range(i % 3)]
        out.append((j + p + k, [0] * len(j) + [1] * len(p) + [0] * len(k)))
        out.append((j + k + j, [0] * (2 * len(j) + len(k))))
        out.append((p, [1] * len(p)))
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def line_quality(docs: DataFrame, share: float = SHARE, labelled: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """Counts, rules and verdict of every row of docs (doc_id, text)."""
    w, t = fit_field(labelled or labelled_lines())
    t = t.tolist()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = np.cumsum([len(x.as_buffer()) + 1 for x in texts]) if len(texts) else []
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                b = Batch(texts.slice(at, end - at).to_pylist())
                scores, held = (b.features @ w).tolist(), []
                for i, j in zip(b.lines_of[:-1].tolist(), b.lines_of[1:].tolist()):
                    held.append(float(np.dot(viterbi(scores[i:j], t), b.line_chars[i:j])) if j > i else 0.0)
                content = np.array(held) / np.maximum(1, b.word_chars)
                failed = (b.n_words < MIN_WORDS) | (100 * b.n_repeat > 50 * b.n_words)
                cols = [batch.column(0).slice(at, end - at), *map(pa.array, (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat, failed, ~failed & (content >= share), content))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])
                at = end

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(judge, SCHEMA)
