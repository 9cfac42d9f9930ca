"""Subject areas of documents by weighted terms and a multi-pattern automaton.

Curated terms (``CURATED``: beginnings of words that the scope notes stand for, in
the languages of the corpus) are joined by terms of one to four words taken from
hand-labelled documents: how much more often a term occurs under a subject than
elsewhere decides whether it stands for it.  Matching the labelled documents again
removes terms, curated ones too, that don't hold up.  All terms go into one
Aho-Corasick automaton that reads every document once, sentence by sentence,
longest match first.  A term weighs its log odds times its rarity over all
documents; a sentence's weight for a subject is normalised by the sentence's
length and must pass a calibrated threshold; a document gets every subject to
which it gives ``ENOUGH`` sentences.

Only the fit looks at a bounded sample: at most ``MAX_LABELLED`` labelled
documents, those with the smallest hash of their id.  Counts, rarity and results
cover all documents, whole.

Defined results: null and empty texts give no subject; labels with unknown
subjects or for unknown documents are ignored, repeated ones count once;
without labels the curated terms alone assign, at the lowest threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.text import _WORD, sentences
from vectrail.session import cut, scratch

MAX_LABELLED = 20_000
LONGEST = 4
#: A term must occur in so many labelled documents, this share of them under its subject, with this much evidence.
MIN_DOCS, PURITY, EVIDENCE = 3, 0.65, 6.0
#: Sentences a document must give to a subject.
ENOUGH = 3
#: Thresholds tried for a sentence's weight.
LEVELS = (0.25, 0.5, 1.0, 2.0)
#: A curated term counts as if it had been seen in so many documents, this share of them under its subject.
PRIOR_DOCS, PRIOR = 2.0, 0.9

#: Curated terms by subject: beginnings of words without diacritics, in en, de, es and fr; `+` joins the words of a term,
#: one at the end stands for the whole word.
CURATED = {
    "genomics": "genom transcri transkri promot enhancer exon chromatin cromatin locus sequenc sequenz secuenc codon nucleot allel methyl metil crispr plasmid guide+librar guide+rna read+depth",
    "statistics": "statist estadist regres variance varianz covarian calibr kalibr probabil wahrscheinl quantil likelihood bootstrap permut confidence+interval konfidenz correlat korrelat residu outlier stichprob hypothes standard+deviat sample+size null+distribut posterior+ p+value+ degree+of+freedom error+rate skew shrinkage",
    "software": "softwar compil kompil repositor unit+test memory+leak thread+pool release+branch deploy server cache container+image refactor debug regression+test pull+request merge+request build+job schnittstell programm api+ stack+trace null+pointer race+condition rollback hotfix scheduler linter source+code quelltext codigo+fuente code+source versionsverwalt",
    "immunology": "immun inmun antigen antikor anticorp anticuerp cytokin zytokin citoqu citocin lymphocyt lymph+nod lymphknot inflam entzund macroph makroph neutroph interleuk interferon t+cell t+zell nk+cell mast+cell",
    "oncology": "tumor tumour tumeur oncogen onkogen carcino karzin cancer krebs metasta lymphom linfom sarcom sarkom gliom melanom leuk biops malign benign angiogen neoplas driver+mutat radiotherap relaps remission xenograft",
    "pharmacology": "pharma farma dose dosi dosag bioavail bioverfug biodispon half+life halbwert vida+media demi+vie plasmaspiegel wirkstoff arznei medicament medikament toxic toxiz agonist antagonist vertraglich drug placebo excipient ligand potency clearance regimen side+effect",
    "data_governance": "licen lizenz consent einwillig privac datenschutz retention aufbewahr retencion anonym pseudonym redistribut data+transfer data+sharing complian embargo confidential vertraulich copyright steward jurisdict access+request legal+hold ethi",
    "bench_work": "pipet incuba inkuba centrifug zentrifug reagen freezer gefrier congela wash+buffer puffer cell+passag flow+cytom biosafety transfect microscop mikroskop autoclav vortex water+bath fume+hood agar pcr+tube cryovial",
}


class _Stems(dict):
    """Stems of words seen before; '' for a word that begins with a digit.  Emptied when it has grown large."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[w] = out = "" if w[0].isdigit() else w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] not in "su" else w
        return out


def sentence_tokens(text: str, stems: _Stems | None = None) -> list[list[str]]:
    stems = _Stems() if stems is None else stems
    return [[t for w in _WORD.findall(s) if (t := stems[w])] for s in sentences(text)]


def curated(subjects: list[str]) -> dict[str, int]:
    """Curated terms with the number of their subject; a term that ends in ``*`` is the beginning of a word."""
    at = {s.strip().lower().replace(" ", "_").replace("-", "_"): k for k, s in enumerate(subjects)}
    term = lambda w: w[:-1].replace("+", " ") if w.endswith("+") else w.replace("+", " ") + "*"
    return {term(w): at[s] for s, words in CURATED.items() if s in at for w in words.split()}


def automaton(terms: list[str]):
    """Terms as patterns over tokens joined by two spaces, so that neighbours don't overlap."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        body = f" {term.replace(' ', '  ')} "
        a.add_word(body[:-2] if term.endswith("*") else body, k)
    a.make_automaton()
    return a


def find(a, tokens: list[str]) -> list[int]:
    return [k for _, k in a.iter_long(f" {'  '.join(tokens)} ")] if tokens and len(a) else []


def _labelled(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(id, body, mask): a bounded sample of labelled documents as tokens in sentences, one bit per subject."""
    plain = F.regexp_replace(F.lower(F.trim("subject")), "[^a-z0-9]+", "_")
    known = {s.strip().lower().replace(" ", "_").replace("-", "_"): k for k, s in enumerate(subjects)}
    bit = F.lit(None).cast("long")
    for name, k in known.items():
        bit = F.when(plain == name, F.lit(1 << k).cast("long")).otherwise(bit)
    masks = (
        labels.select(F.col(key).alias("id"), bit.alias("b"))
        .where("b IS NOT NULL AND id IS NOT NULL")
        .groupBy("id")
        .agg(F.bit_or("b").alias("mask"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MAX_LABELLED)  # the documented bound of the fit
    )
    mine = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(masks, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _Stems()
        for batch in batches:
            bodies = ["\n".join(" ".join(s) for s in sentence_tokens(t, stems)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), batch.column(2)], names=["id", "body", "mask"])

    return mine.select("id", "text", "mask").mapInArrow(run, f"id {dict(docs.dtypes)[key]}, body string, mask long")


def _sentences(body: str) -> list[list[str]]:
    return [s.split(" ") for s in body.split("\n") if s]


def _count(sample: DataFrame, emit, n_subjects: int) -> DataFrame:
    """(term, n, c0, c1, ...): documents per term and subject; ``emit`` gives a document's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            terms, masks = [], []
            for body, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in emit(body, state):
                    terms.append(t), masks.append(mask)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(masks, pa.int64())], names=["term", "mask"])

    rows = sample.select("body", "mask").mapInArrow(run, "term string, mask long")
    return rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(f"shiftright(mask, {k}) & 1")).alias(f"c{k}") for k in range(n_subjects)],
    )


def _evidence(c: Column, n: Column, p: float) -> Column:
    """Log-likelihood ratio of c successes in n against the rate p; 0 if not above it."""
    if not 0 < p < 1:
        return F.lit(0.0)
    q = c / n
    miss = F.when(q < 1, (n - c) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, 2 * (c * F.log(q / p) + miss)).otherwise(0.0)


def _best(counted: DataFrame, base: list[float]) -> DataFrame:
    """``counted`` with the subject each term is most evident for, its documents there, and the evidence."""
    n = F.col("n")
    each = [F.struct(_evidence(F.col(f"c{i}"), n, p).alias("e"), F.lit(-i).alias("neg"), F.col(f"c{i}").alias("c"), F.lit(float(p)).alias("p")) for i, p in enumerate(base)]
    top = F.array_max(F.array(*each))
    return counted.withColumn("b", top).select("term", "n", (-F.col("b.neg")).alias("subject"), F.col("b.c").alias("c"), F.col("b.e").alias("e"), F.col("b.p").alias("p"))


@dataclass
class Terms:
    """Terms with their subjects' numbers, log odds, and the weight a sentence must have."""

    names: list[str]
    subject: list[int]
    odds: list[float]
    level: float = LEVELS[0]


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> tuple[Terms, DataFrame]:
    """Terms of the subjects, and the sample they were fitted on."""
    k = len(subjects)
    given = curated(subjects)
    sample = scratch(_labelled(docs, key, text, labels, subjects))
    total = sample.agg(F.count(F.lit(1)), *[F.sum(F.expr(f"shiftright(mask, {i}) & 1")) for i in range(k)]).first()
    size = total[0]
    base = [(total[i + 1] or 0) / size if size else 0.0 for i in range(k)]

    def single(body: str, state: dict) -> set[str]:
        return {w for s in _sentences(body) for w in s}

    # Words that tell at all; only they may begin or end a term.
    tells = "n >= 2 AND e >= 4 AND c / n >= 1.5 * p + 0.05"
    telling = {r["term"] for r in _best(_count(sample, single, k), base).where(tells).select("term").toLocalIterator()} if size else set()

    def several(body: str, state: dict) -> set[str]:
        out = set()
        for s in _sentences(body):
            for i, w in enumerate(s):
                if w in telling:
                    for n in range(1, LONGEST + 1):
                        if i + n <= len(s) and s[i + n - 1] in telling:
                            out.add(" ".join(s[i : i + n]))
        return out

    # What is fetched are the chosen terms, bounded by the sample's vocabulary.
    pure = _best(_count(sample, several, k), base).where((F.col("n") >= MIN_DOCS) & (F.col("c") / F.col("n") >= PURITY) & (F.col("e") >= EVIDENCE))
    chosen = {r["term"]: (r["subject"], r["c"] / r["n"]) for r in pure.toLocalIterator()} if telling else {}
    chosen = _prune(sample, chosen, given, k)
    chosen = _prune(sample, {**_neighbours(sample, chosen, telling, base, k), **chosen}, given, k)
    names = sorted(chosen)
    odds = [math.log((chosen[t][1] + 0.02) / (1.02 - chosen[t][1])) + 1.0 for t in names]
    return Terms(names, [chosen[t][0] for t in names], odds), sample


def _prune(sample: DataFrame, chosen: dict[str, tuple[int, float]], given: dict[str, int], k: int) -> dict[str, tuple[int, float]]:
    """Terms that keep their subject when longest matches win, with the share they then have.

    Curated terms (``given``) stay unless the labels speak against them.
    """
    all_terms = {**{t: (i, PRIOR) for t, i in given.items()}, **chosen}
    names = sorted(all_terms)

    def matched(body: str, state: dict) -> set[str]:
        if "a" not in state:
            state["a"] = automaton(names)
        return {names[i] for s in _sentences(body) for i in find(state["a"], s)}

    seen = {r["term"]: r for r in _count(sample, matched, k).toLocalIterator()}  # one row per term
    out = {}
    for t, (i, _) in all_terms.items():
        n, c = (seen[t]["n"], seen[t][f"c{i}"]) if t in seen else (0, 0)
        if t in given:
            share = (c + PRIOR_DOCS * PRIOR) / (n + PRIOR_DOCS)
            if share >= PURITY:
                out[t] = (i, share)
        elif n >= 2 and c / n >= PURITY:
            out[t] = (i, c / n)
    return out


def _neighbours(sample: DataFrame, chosen: dict, telling: set[str], base: list[float], k: int) -> dict:
    """Terms too rare to be chosen alone that keep to sentences of one subject's terms."""
    names = sorted(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(names)
        for batch in batches:
            terms, beside, masks = [], [], []
            for body, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in _sentences(body):
                    hit = find(a, s)
                    of = {chosen[names[i]][0] for i in hit}
                    used = {w for i in hit for w in names[i].split()}
                    begun = tuple(w[:-1] for w in used if w.endswith("*"))
                    one = of.pop() if len(of) == 1 else -1
                    for i, w in enumerate(s):
                        for n in range(1, LONGEST + 1):
                            part = s[i : i + n]
                            if len(part) == n and w in telling and part[-1] in telling:
                                terms.append(" ".join(part))
                                beside.append(-1 if used & set(part) or (begun and any(p.startswith(begun) for p in part)) else one)
                                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(beside, pa.int32()), pa.array(masks, pa.int64())], names=["term", "s", "mask"]
            )

    rows = sample.select("body", "mask").mapInArrow(run, "term string, s int, mask long")
    counts = rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("s") >= 0).alias("beside"),
        *[F.count_if(F.col("s") == i).alias(f"b{i}") for i in range(k)],
        *[F.sum(F.expr(f"shiftright(mask, {i}) & 1")).alias(f"c{i}") for i in range(k)],
    )
    each = [F.struct(F.col(f"b{i}").alias("b"), F.lit(-i).alias("neg"), F.col(f"c{i}").alias("c"), _evidence(F.col(f"b{i}"), F.col("beside"), p).alias("e")) for i, p in enumerate(base)]
    best = counts.where("beside >= 2").withColumn("t", F.array_max(F.array(*each)))
    kept = best.where(
        (F.col("t.b") >= 2) & (F.col("t.b") / F.col("beside") >= 0.85) & (F.col("beside") >= 0.4 * F.col("n"))
        & (F.col("t.c") / F.col("n") >= PURITY) & (F.col("t.e") >= 4)
    )
    return {r["term"]: (-r["t"]["neg"], r["t"]["c"] / r["n"]) for r in kept.select("term", "n", "t").toLocalIterator() if r["term"] not in chosen} if telling else {}


def hits(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(id, s, len, terms): the sentences of every document in which terms were found."""
    sent = docs.sparkSession.sparkContext.broadcast(names)  # short strings, bounded by the vocabulary of the bounded sample
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, stems = None, _Stems()
        for batch in batches:
            a = a or automaton(sent.value)
            rows, at, sizes, found = [], [], [], []
            for r, body in enumerate(batch.column(1).to_pylist()):
                for s, tokens in enumerate(sentence_tokens(body, stems)):
                    if terms := find(a, tokens):
                        rows.append(r), at.append(s), sizes.append(len(tokens)), found.append(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(at, pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array(found, pa.list_(pa.int32())),
                ],
                names=["id", "s", "len", "terms"],
            )

    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return narrow.mapInArrow(run, f"id {kind}, s int, len int, terms array<int>")


def strengths(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, s, subject, w): what each sentence gives to its foremost subject, normalised by its length."""
    each = found.select("id", "s", "len", F.explode("terms").alias("term")).join(weights, "term")
    per = each.groupBy("id", "s", "subject").agg(
        (F.sum("weight") / F.greatest(F.lit(1.0), F.sqrt(F.first("len") / F.lit(20.0)))).alias("w")
    )
    best = per.groupBy("id", "s").agg(F.max(F.struct("w", (-F.col("subject")).alias("neg"))).alias("b"))
    return best.select("id", "s", (-F.col("b.neg")).alias("subject"), F.col("b.w").alias("w"))


def _calibrate(terms: Terms, given: DataFrame, sample: DataFrame) -> Terms:
    """The sentence threshold that fits the labels best; the lowest of equals."""
    mine = given.join(sample.select("id", "mask"), "id")
    per = mine.groupBy("id", "subject", "mask").agg(*[F.count_if(F.col("w") >= v).alias(f"n{i}") for i, v in enumerate(LEVELS)])
    right = F.expr("shiftright(mask, subject) & 1") == 1
    row = per.agg(*[x for i in range(len(LEVELS)) for x in (F.count_if((F.col(f"n{i}") >= ENOUGH) & right), F.count_if((F.col(f"n{i}") >= ENOUGH) & ~right))]).first()
    wanted = sample.agg(F.sum(F.bit_count("mask"))).first()[0] or 0
    scores = [2 * (row[2 * i] or 0) / max(1, (row[2 * i] or 0) + (row[2 * i + 1] or 0) + wanted) for i in range(len(LEVELS))]
    terms.level = LEVELS[max(range(len(LEVELS)), key=lambda i: (scores[i], -i))]
    return terms


def weigh(docs: DataFrame, key: str, text: str, terms: Terms) -> DataFrame:
    """(id, s, subject, w): what each sentence of every document gives to its foremost subject."""
    spark = docs.sparkSession
    found = scratch(hits(docs, key, text, terms.names))
    total = docs.count()
    df = found.select("id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    listed = spark.createDataFrame(
        [(i, terms.subject[i], terms.odds[i]) for i in range(len(terms.names))], "term int, subject int, odds double"
    )
    rarity = F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) / F.lit(math.log(1.0 + max(1, total)))
    weights = cut(listed.join(df, "term").select("term", "subject", (F.col("odds") * (F.lit(0.5) + rarity)).alias("weight")))
    return scratch(strengths(found, weights))


def choose(given: DataFrame, key: str, terms: Terms, subjects: list[str]) -> DataFrame:
    """(key, subject, n_sentences): every subject to which a document gives enough sentences that weigh enough."""
    names = given.sparkSession.createDataFrame(list(enumerate(subjects)), "subject int, name string")
    return (
        given.where(F.col("w") >= terms.level)
        .groupBy("id", "subject")
        .agg(F.count(F.lit(1)).cast("int").alias("n_sentences"))
        .where(F.col("n_sentences") >= ENOUGH)
        .join(F.broadcast(names), "subject")
        .select(F.col("id").alias(key), F.col("name").alias("subject"), "n_sentences")
    )


def assign(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(key, subject, n_sentences): every subject each document is about."""
    terms, sample = fit(docs, key, text, labels, subjects)
    given = weigh(docs, key, text, terms)
    return choose(given, key, _calibrate(terms, given, sample), subjects)
