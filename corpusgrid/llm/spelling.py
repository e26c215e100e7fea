"""Spelling variants: words one edit apart, found by a forward and a backward automaton.

Two words one edit apart share their first half or their second one exactly. So each word goes to the
group of its first half (forward) and to that of its second half (backward), among words of its length and
of one letter more. Groups are packed into buckets; a bucket's words make one minimal acyclic automaton
(backward: of the words reversed) whose paths count off a perfect-hash number for each word. A word walks
its half exactly, completes the rest with one error, and the numbers reached lead to the frequencies. A pair
that shares both halves is taken forward only, so none counts twice, and what leaves a bucket is one row
for each word: how many words are near and the most frequent of them, never the pairs.

A group may be crowded (a third of all words may begin alike). Its members are dealt again by finer pieces:
of the part that may hold the error, the first or the second half must be exact too. That ends with words
that differ in one place, which the alphabet bounds, so every group fits a task and no word is left out.

Defined results: null texts have no words; repeated rows count again; a null id is an empty one where runs
are varied by id; no rows give no words; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.runtime import cut, ship

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters and occurrences that make a word; how much more frequent a form is than its variant.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: Members of a group or, about, of a bucket. A group whose open part is one letter long has fewer.
CROWD = 20_000
#: Names of crowded groups that may be broadcast; with more of them none holds more than a small share.
NAMES = 50_000

NEAR = "word string, n long, n_near long, form_n long, form string"


def _low(run: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` does that where no other letter has another case."""
    plain = (F.octet_length(run) == F.length(run)) | ~run.rlike("[\\u00C0-\\u00DE]")
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def occurrences(docs: DataFrame, slips: int = 0) -> DataFrame:
    """One row (word) for each run of at least LETTERS letters of each text. With ``slips`` a run loses a
    letter where ``slips`` divides the CRC-32 of ``doc_id:run``, as a slip of the pen."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LETTERS},}}"), F.lit(0))).alias("run"))
    low = runs.select("key", _low(F.col("run")).alias("low"))
    if not slips:
        return low.select(F.col("low").alias("word"))
    h = F.crc32(F.concat("key", F.lit(":"), "low"))
    hashed = low.select("low", h.alias("h"))
    at = (F.col("h") % F.length("low")).cast("int")
    cutting = F.concat(F.substr("low", F.lit(1), at), F.substr("low", at + 2))
    return hashed.select(F.when(F.col("h") % slips == 0, cutting).otherwise(F.col("low")).alias("word")).filter(F.length("word") >= LETTERS)


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n of the words with enough occurrences."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


# -- groups ---------------------------------------------------------------------------------------


def _keyed(members: DataFrame) -> DataFrame:
    """Members with the group's key: how many letters are exact at either end, and which."""
    exact = F.concat(F.substr("word", F.lit(1), F.col("head")), F.lit("|"), F.when(F.col("tail") > 0, F.substring(F.reverse("word"), F.lit(1), F.col("tail"))).otherwise(F.lit("")))
    return members.withColumn("group", F.concat_ws("|", "least", "head", "tail", "unlike", exact))


def first_groups(words: DataFrame) -> DataFrame:
    """word, n, least (the shorter length of the group's pairs), head and tail (exact letters at either end),
    unlike (as many first letters may not be equal, else the pair is another group's) and group."""
    size = F.length("word")
    shorter = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("least")).filter(F.col("least") >= LETTERS)
    half = F.floor(F.col("least") / 2).cast("int")
    none = F.lit(0)
    ways = F.array(F.struct(half.alias("head"), none.alias("tail"), none.alias("unlike")), F.struct(none.alias("head"), (F.col("least") - half).alias("tail"), half.alias("unlike")))
    return _keyed(shorter.select("word", "n", "least", F.inline(ways)))


def _finer(members: DataFrame) -> DataFrame:
    """Members of crowded groups by the halves of the part that is open."""
    open_ = F.col("least") - F.col("head") - F.col("tail")
    more = F.floor(open_ / 2).cast("int")
    head = F.col("head") + more
    ways = F.array(
        F.struct(head.alias("head"), F.col("tail"), F.col("unlike")),
        F.struct(F.col("head"), (F.col("tail") + open_ - more).alias("tail"), head.alias("unlike")),
    )
    return _keyed(members.select("word", "n", "least", F.inline(ways)))


def groups(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The members of all groups, crowded ones dealt finer until none is: their number is counted in each
    round, and the names of crowded groups stay in a table."""
    members, settled = first_groups(words), None
    while True:
        # a group with one open letter, or none, is as fine as it gets
        counted = members.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.first(F.col("least") - F.col("head") - F.col("tail")).alias("o"))
        crowded = cut(counted.filter((F.col("c") > crowd) & (F.col("o") > 1)).select("group"))
        if crowded.isEmpty():
            return members if settled is None else settled.unionByName(members)
        # a crowded group's members are many, the names of such groups few: by a broadcast of the names no
        # task gets a whole group
        names = F.broadcast(crowded) if crowded.limit(NAMES + 1).count() <= NAMES else crowded
        rest = members.join(names, "group", "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        members = cut(_finer(members.join(names, "group", "left_semi")))


# -- automata -------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of sorted words; the number of a word is its place among them.

    ``edges[state]`` maps a letter to (next state, words passed over): the sum of what a path passes over is
    the number of the word it spells.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # the path of the last word: letters to states that are not final yet
        path: list[tuple[dict, list]] = [({}, [False])]
        letters: list[str] = []

        def settle(node: tuple[dict, list]) -> int:
            children, ends = node
            key = (ends[0], tuple(children.items()))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.edges)
                passed, held = int(ends[0]), {}
                for letter, child in children.items():
                    held[letter] = (child, passed)
                    passed += self.size[child]
                self.edges.append(held)
                self.final.append(ends[0])
                self.size.append(passed)
            return state

        for word in words:
            same = 0
            while same < len(letters) and same < len(word) and letters[same] == word[same]:
                same += 1
            while len(letters) > same:
                node = path.pop()
                path[-1][0][letters.pop()] = settle(node)
            for letter in word[same:]:
                letters.append(letter)
                path.append(({}, [False]))
            path[-1][1][0] = True
        while letters:
            node = path.pop()
            path[-1][0][letters.pop()] = settle(node)
        self.start = settle(path[0])

    def walk(self, word: str, state: int, number: int, at: int = 0) -> tuple[int, int] | None:
        """State and number after the letters of ``word`` from ``at`` on, or None."""
        edges = self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        found = self.walk(word, self.start, 0)
        return found[1] if found and self.final[found[0]] else None

    def near(self, word: str, exact: int, until: int) -> Iterator[tuple[int, int, bool]]:
        """(number, place, longer) of all words that agree with ``word`` on its first ``exact`` letters and have
        another letter at a place before ``until``, or one more letter before or at it. An added letter that
        repeats the one before it spells the same word as one place earlier, so each word comes once."""
        found = self.walk(word[:exact], self.start, 0)
        if found is None:
            return
        state, number = found
        size = len(word)
        for place in range(exact, until + 1):
            edges, last = self.edges[state], word[place - 1] if place > exact else None
            own = word[place] if place < size else None
            for letter, (child, passed) in edges.items():
                if letter != last and (end := self.walk(word, child, number + passed, place)) and self.final[end[0]]:
                    yield end[1], place, True
                if letter != own and place < until and (end := self.walk(word, child, number + passed, place + 1)) and self.final[end[0]]:
                    yield end[1], place, False
            step = edges.get(own) if own is not None else None
            if step is None:
                return
            state, number = step[0], number + step[1]


def bucket_near(members: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words with what is near them within its groups. All groups of a bucket are forward
    (``back`` false: more letters are exact at the head) or all are backward."""
    back = bool(members["back"].iloc[0])
    held = members.drop_duplicates("word")
    spelled = held["word"].map(lambda w: w[::-1]) if back else held["word"]
    order = np.argsort(spelled.to_numpy(dtype=object), kind="stable")
    spelled, words, n = [list(x.to_numpy()[order]) for x in (spelled, held["word"], held["n"])]
    automaton = Automaton(spelled)
    near = [0] * len(words)
    best: list[tuple[int, str] | None] = [None] * len(words)

    def link(a: int, b: int) -> None:
        near[a] += 1
        offered = (-n[b], words[b])
        if best[a] is None or offered < best[a]:
            best[a] = offered

    fields = zip(*[members[c] for c in ("word", "least", "head", "tail", "unlike")], strict=True)
    for word, least, head, tail, unlike in fields:
        if len(word) != least:  # the longer word of a pair is found from the shorter one
            continue
        exact, rest = (tail, head) if back else (head, tail)
        shown = word[::-1] if back else word
        own = automaton.number(shown)
        for other, _, longer in automaton.near(shown, exact, least - rest):
            if unlike and words[other][:unlike] == word[:unlike]:
                continue  # a pair of the other half's group
            link(own, other)
            if longer:
                link(other, own)
    rows = [(w, c, k, None if b is None else -b[0], None if b is None else b[1]) for w, c, k, b in zip(words, n, near, best, strict=True)]
    return pd.DataFrame(rows, columns=["word", "n", "n_near", "form_n", "form"]).astype({"form_n": "Int64"})


def neighbours(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, and form and form_n: the most frequent near word, the smallest of those that tie."""
    spark = words.sparkSession
    ship(spark)
    dealt = groups(words, crowd)
    count = words.count()
    # each word is in four groups at most, half of them backward, and more where groups are crowded
    buckets = max(2 * spark.sparkContext.defaultParallelism, 4 * count // crowd + 1)
    back = F.col("tail") > F.col("head")
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)) * 2 + back.cast("int")
    parts = dealt.select("word", "n", "least", "head", "tail", "unlike", back.alias("back"), bucket.alias("bucket"))
    tasks = min(2 * buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    found = parts.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(bucket_near, NEAR)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("behind"), F.col("form")))).alias("best")
    whole = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return whole.select("word", "n", "n_near", F.col("best.form"), (-F.col("best.behind")).alias("form_n"))


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent near word if that is ``ratio``
    times as frequent; its root is where the forms lead. Frequencies grow by ``ratio`` with each step, so
    paths are short; their lengths double in each round."""
    near = cut(neighbours(words, crowd))
    told = (F.col("form_n") >= ratio * F.col("n"))
    forms = near.select("word", "n", "n_near", F.when(told, F.col("form")).alias("form"), F.when(told, F.col("form_n")).alias("form_n"))
    leads = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        then = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(leads.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        leads = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return forms.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
