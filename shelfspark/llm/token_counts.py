"""Token counts of fields by offset-mapped attribution.

Each whole document is encoded once. A byte-level vocabulary says how many bytes every token has, so running sums of these
lengths give each token's byte span in the document; spans are turned into character spans and joined to the
document's sections, which are sorted intervals, by binary search. A token that crosses a boundary is allocated by rule:

* "first": to the section of its first character (counts are whole and add up to the document's tokens);
* "most": to the section with most of its bytes, the earlier one if equal;
* "share": to each section by its share of the token's bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .sst import encoder, tokenizer_path

RULES = ("first", "most", "share")


def token_bytes(library):
    """Bytes of each token of a byte-level vocabulary: one for each character of its written form."""
    import numpy as np

    out = np.zeros(library.get_vocab_size(), "i8")
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    for token, i in library.get_vocab().items():
        out[i] = len(token.encode()) if token in special else len(token)
    return out


def attribute(spans, bounds, rule: str):
    """Tokens of each section. spans: end of each token in bytes; bounds: end of each section, rising, the last one the text's."""
    import numpy as np

    ends = np.asarray(spans, "i8")
    starts = np.concatenate([[0], ends[:-1]]).astype("i8") if len(ends) else ends
    bounds = np.asarray(bounds, "i8")
    first = np.minimum(np.searchsorted(bounds, starts, side="right"), len(bounds) - 1)
    if rule == "first":
        return np.bincount(first, minlength=len(bounds)).astype("f8")
    last = np.minimum(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right"), len(bounds) - 1)
    whole = first == last
    out = np.bincount(first[whole], minlength=len(bounds)).astype("f8")
    for i in np.flatnonzero(~whole):  # tokens across a boundary
        k = np.arange(first[i], last[i] + 1)
        low = np.concatenate([[starts[i]], bounds[k[:-1]]])
        share = np.minimum(bounds[k], ends[i]) - low
        if rule == "share":
            out[k] += share / share.sum()
        else:
            out[k[int(share.argmax())]] += 1
    return out


def section_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", rule: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each section of each row of docs: key, section_no, char_start, char_end, n_tokens, doc_tokens.

    Sections are the lines of a text, each with the line break that ends it, so that they cover the text without gap.
    A null or empty text is one empty section with no tokens. Under "first" and "most" n_tokens is whole; it is a double
    for all rules. Rows with one key, null keys and repeated rows are counted row by row; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    small_batches(docs.sparkSession)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        coder = encoder(tokenizer_path(vocabulary))
        if not coder.by_piece:
            raise ValueError("offsets are mapped for byte-level vocabularies only")
        lengths = token_bytes(coder.library)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list] = [[], [], [], [], [], []]
            for k, t, ids in zip(keys, texts, coder.encode(texts), strict=True):
                raw = np.frombuffer(t.encode(), "u1")
                bounds = np.flatnonzero(raw == 10) + 1
                if not len(bounds) or bounds[-1] != len(raw):
                    bounds = np.concatenate([bounds, [len(raw)]])
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
                n = attribute(np.cumsum(lengths[ids]), bounds, rule)
                ends = chars[bounds]
                for col, part in zip(cols, ([k] * len(bounds), range(len(bounds)), [0, *ends[:-1].tolist()], ends.tolist(), n.tolist(), [len(ids)] * len(bounds)), strict=True):
                    col.extend(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            names = ["doc_id", "section_no", "char_start", "char_end", "n_tokens", "doc_tokens"]
            for i in range(0, len(cols[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], t) for c, t in zip(cols, kinds, strict=True)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "doc_id long, section_no int, char_start long, char_end long, n_tokens double, doc_tokens long").withColumnRenamed("doc_id", key)
