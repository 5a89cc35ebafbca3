"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of masks holds the filters of all languages: bit l of a slot is that slot's bit in language l's filter, so the
masks at an n-gram's slots, and-ed, name every language that contains it. A text's popcounts per language, corrected for
each filter's false positives, decide. A mask has a word for every 64 languages.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, short_batches, text_parts

ORDERS = (3, 4)
SLOT_BITS, HASHES = 20, 3
#: Rows of each language that the filters are fitted on, about: a bound on the fit, not on what is predicted. Of more
#: languages than MOST_LANGUAGES those with the most labelled documents are learned.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 3000, 1024
#: Characters of texts whose n-grams are held at once; they take about 150 bytes a character. Longer texts are cut.
TOGETHER = 1 << 18
#: A language contains an n-gram if so many of its sampled documents have it, and so many times the share of the
#: language that has it most often.
LEAST_SHARE, LEAST_RATIO = 0.005, 0.2
#: An accepted document has this share of its n-grams in its language at least.
LEAST_COVERAGE = 0.1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(lowered: str) -> np.ndarray:
    return np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(code: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(code) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + len(h)]
    return _mix(h)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the index of each one's text, and which texts have a letter. Texts are lower-cased, runs
    of other characters than letters count as one space, and a text begins and ends with one."""
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    code = _codes("".join(lowered))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    is_letter = letters()[code]
    has = np.zeros(len(texts), bool)
    has[owner[is_letter]] = True
    keep = np.ones(len(code), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = np.where(is_letter, code, 32)[keep].astype(np.uint64), owner[keep]
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    for n in ORDERS:
        m = max(0, len(code) - n + 1)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        hashes.append(_hashes(code, n)[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(hashes), np.concatenate(owners), has


def gram_parts(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The n-grams of one long text as grams() has them, TOGETHER characters at a time, and whether there is a letter."""
    lowered, after_letter = f" {text.lower()} ", True  # the first space stays
    held = np.empty(0, np.uint64)
    for a in range(0, len(lowered), TOGETHER):
        code = _codes(lowered[a : a + TOGETHER])
        is_letter = letters()[code]
        keep = is_letter | np.concatenate([[after_letter], is_letter[:-1]])
        after_letter = bool(is_letter[-1])
        code = np.concatenate([held, np.where(is_letter, code, 32)[keep].astype(np.uint64)])
        new = [_hashes(code[max(0, len(held) - n + 1) :], n) for n in ORDERS]
        held = code[max(0, len(code) - max(ORDERS) + 1) :]
        yield np.concatenate(new), bool(is_letter.any())


def slots(h: np.ndarray) -> list[np.ndarray]:
    width = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * k)) & width).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """Languages, and masks (slots, words of 64 languages)."""

    languages: list[str]
    masks: np.ndarray

    def _bit(self, masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    @cached_property
    def false_positives(self) -> np.ndarray:
        return np.array([self._bit(self.masks, i).mean() for i in range(len(self.languages))]) ** HASHES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The and-ed masks of n-grams: all languages that contain each."""
        first, *others = slots(h)
        mask = self.masks[first]
        for s in others:
            mask &= self.masks[s]
        return mask

    def _votes(self, h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        mask = self.containing(h)
        total = np.bincount(owner, minlength=n_texts).astype(np.float64)
        return total, np.stack([np.bincount(owner, weights=self._bit(mask, i).astype(np.float64), minlength=n_texts) for i in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text."""
        n_texts = len(texts)
        if not self.languages:
            return [UNKNOWN] * n_texts, np.zeros(n_texts), np.zeros(n_texts)
        short = [i for i, t in enumerate(texts) if len(t or "") <= TOGETHER]
        total, found, has = np.zeros(n_texts), np.zeros((len(self.languages), n_texts)), np.zeros(n_texts, bool)
        if short:
            h, owner, has[short] = grams([texts[i] for i in short])
            total[short], found[:, short] = self._votes(h, owner, len(short))
        for i in sorted(set(range(n_texts)).difference(short)):
            for h, some in gram_parts(texts[i]):
                t, f = self._votes(h, np.zeros(len(h), np.int64), 1)
                total[i], found[:, i], has[i] = total[i] + t[0], found[:, i] + f[:, 0], has[i] | some
        fp = np.minimum(self.false_positives, 0.999)
        true = np.maximum(0, (found - fp[:, None] * total) / (1 - fp[:, None]))
        best, everything = true.argmax(axis=0), true.sum(axis=0)
        top = true[best, np.arange(n_texts)]
        score = np.where(has & (everything > 0), top / np.maximum(everything, 1e-12), 0.0)
        coverage = np.where(has, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], score, coverage


def _once(texts: list[str], langs: np.ndarray):
    """(n-gram, language index) of documents, each n-gram of a document once."""
    if len(texts) == 1 and len(texts[0]) > TOGETHER:
        h = np.empty(0, np.uint64)
        for part, _ in gram_parts(texts[0]):
            h = np.union1d(h, part)
        return h, np.full(len(h), langs[0])
    h, owner, _ = grams(texts)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[once], langs[owner[once]]


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang): null texts and languages are left out. Rows that repeat count each.

    About per_language documents of each language, chosen by a hash of doc_id, are read in full. An empty table gives
    filters without languages; other columns are ignored.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    names = sorted(sizes)
    words = max(1, -(-len(names) // 64))
    masks = np.zeros((1 << SLOT_BITS, words), np.uint64)
    if not names:
        return Filters([], masks)
    share = F.create_map(*(x for k in names for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))))
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000
    number = {k: i for i, k in enumerate(names)}

    def count(batches):
        """Documents with each n-gram, and (hash 0) documents, by language."""
        for b in batches:
            for part, texts in text_parts(b, 0, TOGETHER):
                langs = np.array([number[x] for x in part.column(1).to_pylist()], np.int64)
                h, lang = _once(texts, langs)
                for i in np.unique(langs):
                    got, n = np.unique(h[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(got, np.uint64(0)).view(np.int64)), pa.array(np.full(len(got) + 1, i)), pa.array(np.append(n, (langs == i).sum()))], ["gram", "lang", "n"])

    counted = short_batches(rows).where(drawn).select("text", "lang").mapInArrow(count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    of = {r["lang"]: r["n"] for r in counted.where("gram = 0").select(F.explode("by").alias("x")).select("x.*").collect()}
    scale = F.create_map(*(x for i in of for x in (F.lit(i), F.lit(1.0 / of[i]))))
    rated = counted.where("gram <> 0").select("gram", F.transform("by", lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n"), (x["n"] * scale[x["lang"]]).alias("rate"))).alias("by"))
    most = F.array_max(F.transform("by", lambda x: x["rate"]))
    within = F.filter("by", lambda x: (x["rate"] >= LEAST_SHARE) & (x["n"] >= 2) & (x["rate"] >= LEAST_RATIO * most))
    picked = rated.select("gram", F.explode(within).alias("x")).select("gram", F.floor(F.col("x.lang") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x.lang") % 64).cast("int")).alias("bit"))
    width = (1 << SLOT_BITS) - 1
    slot = F.explode(F.array(*(F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit(width).cast("long")) for k in range(HASHES))))
    # At most one row for each slot and word: the table's size is fixed.
    table = picked.select(slot.alias("slot"), "word", "bit").groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks[table["slot"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return Filters(names, masks)


def identify(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns `keep`, and behind them lang_pred string, score double (the language's share of the corrected counts)
    and coverage double (the share of the text's n-grams that its language holds). Where one of these names is kept, the
    new column has underscores behind its name.

    Whole texts count. A null text or one without a letter is `und` with score 0; so is every text if no language was
    learned. A text with letters gets a learned language always, the first of equals. Rows that repeat stay; an empty
    table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))
    held = "text" in keep
    rows = docs.select(*keep) if held else docs.select(*keep, docs["text"].alias(free_name("_text_", *keep)))
    at = keep.index("text") if held else len(keep)
    made = [free_name(x, *keep) for x in ("lang_pred", "score", "coverage")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), *(f"{x} {k}" for x, k in zip(made, ("string", "double", "double")))])

    def run(batches):
        known = Filters(*model.value)
        for b in batches:
            for part, texts in text_parts(b, at, TOGETHER):
                lang, score, coverage = known.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(coverage)], names=[*keep, *made])

    return short_batches(rows).mapInArrow(run, schema)
