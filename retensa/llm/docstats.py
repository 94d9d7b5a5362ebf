"""Exact per-document statistics, computed over whole texts block by block."""

from __future__ import annotations

import numpy as np

from .words import BLANK_CASED, blocks

#: characters counted as symbols
SYMBOLS = b"#*$%&|<>"

_byte = np.arange(256)
_CLASSES = {
    "n_points": (_byte & 0xC0) != 0x80,
    "n_symbols": np.isin(_byte, list(SYMBOLS)),
    "n_upper": (_byte >= 65) & (_byte <= 90),
    "n_digits": (_byte >= 48) & (_byte <= 57),
    "n_punct": np.isin(_byte, list(b".,;:!?'\"()-")),
    "n_bangs": np.isin(_byte, list(b"!?")),
    "n_stops": _byte == 46,
    "n_feeds": _byte == 10,
    "n_outside": _byte >= 128,
}
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points",
          "n_upper", "n_digits", "n_punct", "n_bangs", "n_stops", "n_feeds", "n_outside",
          "n_lines", "n_distinct", "top_count", "n_short"]


def _totals(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, begin[:-1], dtype=np.int64)


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Values that occur twice or more."""
    ordered = np.sort(hashes)
    return ordered[1:][ordered[1:] == ordered[:-1]]


def document_stats(texts: list[bytes]) -> np.ndarray:
    """One row of ``FIELDS`` (int64) per text; an empty text is all zeros."""
    out = np.zeros((len(texts), len(FIELDS)), np.int64)
    col = {name: i for i, name in enumerate(FIELDS)}
    for lo, hi, block in blocks(texts, BLANK_CASED):
        rows = out[lo:hi]
        rows[:, col["n_words"]] = block.counts()
        for name, table in _CLASSES.items():
            rows[:, col[name]] = _totals(table[block.data], block.begin)
        # each text is followed by one joining line feed
        rows[:, col["n_points"]] -= 1
        rows[:, col["n_feeds"]] -= 1
        points = _CLASSES["n_points"][block.data] & BLANK_CASED.is_word[block.data]
        rows[:, col["word_chars"]] = _totals(points, block.begin)
        three, at = block.windows(3)
        cut = np.searchsorted(at, block.first)
        sizes = block.ends - block.starts
        for i in range(hi - lo):
            first, last = block.first[i], block.first[i + 1]
            if first == last:
                continue
            lines = [x for x in texts[lo + i].split(b"\n") if x.strip()]
            rows[i, col["n_lines"]] = len(lines)
            rows[i, col["n_dup_lines"]] = len(lines) - len(set(lines))
            own = np.sort(block.hashes[first:last])
            edge = np.flatnonzero(own[1:] != own[:-1])
            rows[i, col["n_distinct"]] = len(edge) + 1
            rows[i, col["top_count"]] = np.diff(
                np.concatenate(([-1], edge, [len(own) - 1]))).max()
            rows[i, col["n_short"]] = np.count_nonzero(sizes[first:last] <= 3)
            mine = three[cut[i]:cut[i + 1]]
            twice = _repeats(mine)
            if len(twice):
                begin = at[cut[i]:cut[i + 1]][np.isin(mine, twice)] - first
                covered = np.zeros(last - first, bool)
                for j in range(3):
                    covered[begin + j] = True
                rows[i, col["n_repeat_words"]] = np.count_nonzero(covered)
    return out


def rates(stats: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Scale-free rule statistics (float64) from ``document_stats``."""
    s = {name: stats[:, i].astype(float) for i, name in enumerate(FIELDS)}
    words, points = np.maximum(s["n_words"], 1), np.maximum(s["n_points"], 1)
    lines = np.maximum(s["n_lines"], 1)
    out = {
        "log_words": np.log1p(s["n_words"]),
        "word_length": s["word_chars"] / words,
        "symbol_rate": s["n_symbols"] / words,
        "dup_line_rate": s["n_dup_lines"] / lines,
        "repeat_rate": s["n_repeat_words"] / words,
        "upper_rate": s["n_upper"] / points,
        "digit_rate": s["n_digits"] / points,
        "punct_rate": s["n_punct"] / words,
        "bang_rate": s["n_bangs"] / words,
        "stop_rate": s["n_stops"] / words,
        "words_per_line": np.log1p(s["n_words"] / lines),
        "distinct_rate": s["n_distinct"] / words,
        "distinct_scaled": np.log1p(s["n_distinct"]) / np.log1p(words),
        "top_rate": s["top_count"] / words,
        "short_rate": s["n_short"] / words,
        "blank_rate": 1.0 - s["word_chars"] / points,
    }
    return np.column_stack(list(out.values())), list(out)


def stats_frame(docs):
    """(doc_id, FIELDS...) per row of ``docs``; one pass over the whole texts."""
    import pyarrow as pa

    from .common import map_batches
    from .words import utf8_values

    def measure(batch):
        stats = document_stats(utf8_values(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(stats[:, i]) for i in range(len(FIELDS))],
            names=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), measure,
                       f"doc_id {kind}, " + ", ".join(f"{f} long" for f in FIELDS))


def stats_matrix(batch) -> np.ndarray:
    """FIELDS of an Arrow batch as one int64 matrix."""
    return np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy()
                            for f in FIELDS])
