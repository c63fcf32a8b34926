"""Text operators: sentences, tokens, n-grams, detectors, quotes, chunks of whole sentences."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Signs other than letters and digits at a word's edges. Words stand between ASCII white space.
EDGE = r"(?:^|(?<=\s))[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?=\s|$)"


def sentence_array(text: Column, marks: str = r"[.;\n]+") -> Column:
    """Trimmed, not empty."""
    return F.array_remove(F.split(F.trim(text), f" *(?:{marks}) *"), "")


def sentences(docs: DataFrame, key: str = "doc_id", marks: str = r"[.;\n]+") -> DataFrame:
    """(key, sent_no, sentence)."""
    return docs.select(key, F.posexplode(sentence_array(F.col("text"), marks)).alias("sent_no", "sentence"))


def token_array(text: Column) -> Column:
    """Lower-case words without edge punctuation, in order."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), EDGE, ""), r"\s+"), "")


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., sent_no, tok_no, token): lower-case words without edge punctuation, by sentence."""
    s = docs.select(*keep, F.posexplode(sentence_array(F.col("text"))).alias("sent_no", "sentence"))
    return s.select(*keep, "sent_no", F.posexplode(token_array(F.col("sentence"))).alias("tok_no", "token"))


#: Bytes of text whose counts are held at once.
COUNTED_BYTES = 8_000_000
_SPACED = bytes.maketrans(b".;", b"  ")
_PARTED = bytes.maketrans(b";\n", b"..")


def _plain(word: bytes) -> str:
    """Lower case, without signs at its ends."""
    w = word.decode().lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while a < b and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def counted_texts(docs: DataFrame, by: tuple[str, ...], item: str, count) -> DataFrame:
    """(by..., item, n): count(blobs) gives a Counter of texts of one group; some megabytes of text at once, and only counts leave them."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def counted(batch, held, first):
        at, items, counts = [], [], []
        for key, blobs in held.items():
            own = count(blobs)
            at += [first[key]] * len(own)
            items += own
            counts += own.values()
        place = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in range(len(by))), pa.array(items, pa.string()), pa.array(counts, pa.int64())], names=[*by, item, "n"])

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) or [()] * batch.num_rows
            held, first, size = {}, {}, 0
            for k, (key, text) in enumerate(zip(keys, batch.column(len(by)), strict=True)):
                held.setdefault(key, []).append(text.as_py().encode())
                first.setdefault(key, k)
                size += len(held[key][-1])
                if size >= COUNTED_BYTES:
                    yield counted(batch, held, first)
                    held, first, size = {}, {}, 0
            if held:
                yield counted(batch, held, first)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{item}` string, n long"])
    return docs.where("text IS NOT NULL").select(*by, "text").mapInArrow(run, schema).groupBy(*by, item).agg(F.sum("n").alias("n"))


def token_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., token, n) of the tokens of each group's texts. Words are counted as they are written, and each different one is stripped once in a batch."""

    def count(blobs):
        written, out = Counter(), Counter()
        for b in blobs:
            written.update(b.translate(_SPACED).split())
        for word, n in written.items():
            out[_plain(word)] += n
        out.pop("", None)
        return out

    return counted_texts(docs, by, "token", count)


def ngram_counts(docs: DataFrame, n: int, *by: str, sep: str = " ") -> DataFrame:
    """(by..., gram, n) of token n-grams within sentences."""

    def count(blobs):
        known: dict[bytes, str] = {}
        out: Counter = Counter()
        for b in blobs:
            for sentence in b.translate(_PARTED).split(b"."):
                own = []
                for word in sentence.split():
                    token = known.get(word)
                    if token is None:
                        token = known[word] = _plain(word)
                    if token:
                        own.append(token)
                out.update(zip(*(own[k:] for k in range(n)), strict=False))
        return Counter({sep.join(g): k for g, k in out.items()})

    return counted_texts(docs, by, "gram", count)


def words_of(text: Column) -> Column:
    """The tokens of all sentences in one array: sentence marks part words, so they count as white space."""
    return token_array(F.translate(text, ".;", "  "))


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of code points of the padded text: at each place a look ahead, then one step."""
    return F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def sentence_ngrams(text: Column, n: int, sep: str = " ") -> Column:
    """The token n-grams of all sentences in one array; no window over rows."""
    arrays = F.transform(sentence_array(text), lambda s: token_array(s))
    grams = F.transform(arrays, lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.concat_ws(sep, *[F.element_at(a, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>")))
    return F.flatten(grams)


def top_by_count(rows: DataFrame, item: str, k: int, first: str) -> DataFrame:
    """The k commonest items; ties go to the earlier first."""
    return rows.groupBy(item).agg(F.count("*").alias("n"), F.min(first).alias("first")).orderBy(F.desc("n"), "first", item).limit(k)


def token_ngrams(toks: DataFrame, by: list[str], order: list[str], n: int, sep: str = " ") -> DataFrame:
    """n-grams of tokens within by; a null token voids the n-grams it is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    parts = [F.col("token"), *[F.lead("token", k).over(w) for k in range(1, n)]]
    named = toks.select(*by, *[p.alias(f"_{k}") for k, p in enumerate(parts)])
    return named.where(" AND ".join(f"_{k} IS NOT NULL" for k in range(n))).select(*by, F.concat_ws(sep, *[f"_{k}" for k in range(n)]).alias("gram"))


def drop_quotes(sents: Column, verb: str, after: int) -> Column:
    """Sentences without those that match verb and the `after` ones behind each; skipped ones aren't tested."""
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc, s):
        hit = s.rlike(verb)
        return (
            F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["kept"].alias("kept")))
            .when(hit, F.struct(F.lit(after).alias("skip"), acc["kept"].alias("kept")))
            .otherwise(F.struct(F.lit(0).alias("skip"), F.array_append(acc["kept"], s).alias("kept")))
        )

    return F.aggregate(sents, start, step, lambda acc: acc["kept"])


def chunk_numbers(lengths: Column, target: int) -> Column:
    """For an array of sentence lengths the chunk of each: a chunk is cut once it has target words; a last one below half is joined to the one before."""
    start = F.struct(F.lit(0).alias("acc"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(a, n):
        total = a["acc"] + n
        cut = total >= target
        return F.struct(F.when(cut, 0).otherwise(total).alias("acc"), (a["no"] + cut.cast("int")).alias("no"), F.array_append(a["out"], a["no"]).alias("out"))

    def finish(a):
        runt = (a["acc"] > 0) & (a["acc"] < target / 2) & (a["no"] > 0)
        return F.transform(a["out"], lambda c: F.when(runt & (c == a["no"]), c - 1).otherwise(c))

    return F.aggregate(lengths, start, step, finish)
