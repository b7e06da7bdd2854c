"""Account resolution against a chart of accounts, and matches by account name alone.

Texts are made distinct first. Equal names are found with a hash join; containment and edit distance go through the index of
``similar``, so a text meets only the accounts it shares an index entry with, and no product of texts and accounts is formed.
Narrations are compared by their distinct words; a narration then takes the best accounts of its words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import similar
from tallyspark.options import MatchOptions
from tallyspark.session import cut, has_rows, shuffled

BLOCK = 2048
NAMES_PER_ROUND = 4096
STATEMENT = ["statement_id"]
#: Scores of a name found without its punctuation, and of a word that a narration holds.
CONTAINED, WORD_HELD = 0.95, 0.85


def _account(code: str = "account_code", name: str = "account_name", kind: str = "account_type") -> Column:
    return F.struct(F.col(code).alias("code"), F.col(name).alias("name"), F.col(kind).alias("type"))


def _best_account(candidates: DataFrame, coa: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The account of highest score, the lowest index on ties, for every text of candidates (keys, column, score, coa_idx)."""
    best = F.min(F.struct((-F.col("score")).alias("order"), "coa_idx"))
    found = (candidates.groupBy(*keys, column).agg(best.alias("best"))
             .select(*keys, column, (-F.col("best.order")).alias("score"), "best.coa_idx"))
    chart = coa.select(*keys, "coa_idx", _account().alias("account"))
    return found.join(shuffled(chart), [*keys, "coa_idx"]).select(*keys, column, "account", "score")


def _first(rows: DataFrame, form: Column, name: str, keys: list[str]) -> DataFrame:
    """The lowest account index of every non-empty form."""
    return (rows.select(*keys, form.alias(name), "coa_idx").filter(F.col(name) != "")
            .groupBy(*keys, name).agg(F.min("coa_idx").alias("coa_idx")))


def match_by_name(names: DataFrame, coa: DataFrame, options: MatchOptions = MatchOptions(), keys: list[str] = STATEMENT) -> DataFrame:
    """(keys, name, account, score) for the given names that are close enough; names meet the chart with the same keys."""
    least = options.name_threshold
    distinct = cut(names.select(*keys, "name").filter("name <> ''").distinct())

    def forms(c: Column) -> Column:
        return F.explode(F.filter(
            F.array(F.concat(F.lit("p"), text.plain_text(c)), F.concat(F.lit("a"), text.alnum(c))),
            lambda form: F.length(form) > 1)).alias("form")

    first = (coa.select(*keys, "coa_idx", _account().alias("account"), forms(F.col("account_name")))
             .groupBy(*keys, "form").agg(F.min(F.struct("coa_idx", "account")).alias("hit")))
    equal = (distinct.select(*keys, "name", forms(F.col("name")))
             .join(shuffled(first), [*keys, "form"])
             .groupBy(*keys, "name").agg(F.min("hit").alias("hit"))
             .select(*keys, "name", "hit.account", F.lit(1.0).alias("score")))
    rest = cut(distinct.join(shuffled(equal.select(*keys, "name")), [*keys, "name"], "left_anti")
               .withColumns({"plain": text.plain_text(F.col("name")), "alnum": text.alnum(F.col("name"))}))
    accounts = coa.select(*keys, "coa_idx", text.plain_text(F.col("account_name")).alias("plain"),
                          text.alnum(F.col("account_name")).alias("alnum"))
    by_alnum, alnums = _first(accounts, F.col("alnum"), "b", keys), rest.select(*keys, F.col("alnum").alias("a"))
    long = F.length("text") >= text.MIN_WORD_LENGTH, F.length("pattern") >= text.MIN_WORD_LENGTH
    held = similar.containing(alnums.withColumnRenamed("a", "text").filter(long[0]),
                              by_alnum.select(*keys, F.col("b").alias("pattern")).filter(long[1]), keys, similar.LONG_GRAM)
    holds = similar.containing(by_alnum.select(*keys, F.col("b").alias("text")).filter(long[0]),
                               alnums.withColumnRenamed("a", "pattern").filter(long[1]), keys, similar.LONG_GRAM)
    contained = cut(held.select(*keys, F.col("text").alias("a"), F.col("pattern").alias("b"))
                 .union(holds.select(*keys, F.col("pattern").alias("a"), F.col("text").alias("b")))
                 .withColumn("score", F.lit(CONTAINED)))
    within = (F.length("a") >= text.MIN_WORD_LENGTH) & (F.length("b") >= text.MIN_WORD_LENGTH) & (
        F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    close = closest(alnums, by_alnum, contained, keys, least, within)
    fields = [*keys, "name", "score", "coa_idx"]
    scored = (contained.union(close).filter(F.col("score") >= least).join(shuffled(by_alnum), [*keys, "b"])
              .join(shuffled(rest).select(*keys, "name", F.col("alnum").alias("a")), [*keys, "a"]).select(*fields))
    # names or accounts without a letter or digit of a to z and 0 to 9 are compared as they are written
    bare = (F.col("alnum") == "") & (F.col("plain") != "")
    for mine, theirs, needed in ((bare, F.col("plain") != "", rest), (F.col("alnum") != "", bare, accounts)):
        if not has_rows(needed.filter(bare)):
            continue
        written, by_plain = rest.filter(mine), _first(accounts.filter(theirs), F.col("plain"), "b", keys)
        pairs = similar.near(written.select(*keys, F.col("plain").alias("a")), by_plain, keys, least)
        scored = scored.union(pairs.join(shuffled(by_plain), [*keys, "b"])
                              .join(shuffled(written).select(*keys, "name", F.col("plain").alias("a")), [*keys, "a"]).select(*fields))
    return equal.unionByName(_best_account(scored, coa, "name", keys))


def closest(names: DataFrame, chart: DataFrame, contained: DataFrame, keys: list[str], least: float, within: Column) -> DataFrame:
    """keys, a, b, score: of names (keys, a) the pairs with the chart (keys, b) that can be their best, at least; none that is ``within``.

    From three characters on, one edit scores above any two; so names with an account at one edit need no others, and names
    that contain an account, or the reverse (contained: keys, a), need only what reaches that score.
    """
    one = cut(similar.one_edit(names, chart, keys, least).filter(~within))
    open_ = cut(names.join(shuffled(one.filter(F.length("a") >= 3).select(*keys, "a")), [*keys, "a"], "left_anti"))
    held = shuffled(contained.select(*keys, "a"))
    more = similar.near(open_.join(held, [*keys, "a"], "left_anti"), chart, keys, least).union(
        similar.near(open_.join(held, [*keys, "a"], "left_semi"), chart, keys, max(least, CONTAINED)))
    return one.union(more.filter(~within))


def named_whole(narrations: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, narration, name, score: names (keys, name) that stand whole in a narration (keys, narration), 1 as written or 0.95 by
    letters and digits alone. What stands there as written stands there by letters and digits too, so names with enough of
    these are looked up by them alone.
    """
    said = narrations.select(*keys, "narration", text.plain_text(F.col("narration")).alias("plain_n"), text.alnum(F.col("narration")).alias("text"))
    asked = names.select(*keys, "name", text.plain_text(F.col("name")).alias("plain"), text.alnum(F.col("name")).alias("pattern"))
    long = F.length("pattern") >= text.MIN_WORD_LENGTH
    bare = asked.filter(long)
    score = F.when(F.col("plain_n").contains(F.col("plain")), 1.0).otherwise(CONTAINED)
    found = (similar.containing(said, bare, keys, similar.LONG_GRAM).join(shuffled(said), [*keys, "text"]).join(shuffled(bare), [*keys, "pattern"])
             .select(*keys, "narration", "name", score.alias("score")))
    short = asked.filter(~long & (F.col("plain") != ""))
    if not has_rows(short):
        return found
    texts, patterns = said.select(*keys, "narration", F.col("plain_n").alias("text")), short.select(*keys, "name", F.col("plain").alias("pattern"))
    return found.union(similar.containing(texts, patterns, keys).join(shuffled(texts), [*keys, "text"]).join(shuffled(patterns), [*keys, "pattern"])
                       .select(*keys, "narration", "name", F.lit(1.0).alias("score")))


def _inside(narration_words: DataFrame, name_words: DataFrame, keys: list[str]) -> DataFrame:
    return similar.containing(narration_words.withColumnRenamed("a", "text"), name_words.withColumnRenamed("b", "pattern"), keys).select(
        *keys, F.col("text").alias("a"), F.col("pattern").alias("b"), F.lit(WORD_HELD).alias("score"))


def _alike(narration_words: DataFrame, name_words: DataFrame, keys: list[str], least: float) -> DataFrame:
    return similar.near(narration_words, name_words, keys, least).filter(~F.col("a").contains(F.col("b")))


def close_words(narration_words: DataFrame, name_words: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, a, b, score: words b of names (keys, b) that a word a of a narration (keys, a) holds (0.85) or resembles."""
    return (_inside(narration_words, name_words, keys).union(_alike(narration_words, name_words, keys, least))
            .filter(F.col("score") >= least))


def best_words(said: DataFrame, name_words: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The pairs of ``close_words`` that can be the best of a narration (said: keys, narration, a), at least.

    A narration that holds a word has 0.85, so its other words matter only where they reach that.
    """
    inside = cut(_inside(said.select(*keys, "a"), name_words, keys))
    settled = said.join(shuffled(inside.select(*keys, "a")), [*keys, "a"], "left_semi").select(*keys, "narration").distinct()
    open_ = cut(said.join(shuffled(settled), [*keys, "narration"], "left_anti").select(*keys, "a").distinct())
    rest = said.select(*keys, "a").distinct().join(shuffled(open_), [*keys, "a"], "left_anti")
    alike = _alike(open_, name_words, keys, least).union(_alike(rest, name_words, keys, max(least, WORD_HELD)))
    return inside.union(alike).filter(F.col("score") >= least)


def match_by_narration(narrations: DataFrame, coa: DataFrame, options: MatchOptions = MatchOptions(),
                       keys: list[str] = STATEMENT) -> DataFrame:
    """(keys, narration, account, score): the account each narration names best.

    Whole names count first. The others are scored by words: the best account by words is the first one that has the best word,
    and a word of a narration that holds or resembles several keeps one of them, the best, and those closer than a held word
    (which count as held where the narration holds them elsewhere). Only where a name found without its punctuation (0.95)
    meets a closer word are the accounts of that word looked at one by one.
    """
    least = options.fuzzy_threshold
    rows = cut(narrations.select(*keys, "narration").filter("narration <> ''").distinct())
    chart = coa.select(*keys, "coa_idx", F.col("account_name").alias("name"))
    whole = cut(named_whole(rows, _first(chart, F.col("name"), "name", keys), keys))
    named = whole.join(shuffled(chart), [*keys, "name"])
    best_whole = whole.groupBy(*keys, "narration").agg(F.max("score").alias("whole"))
    open_ = (rows.join(shuffled(best_whole), [*keys, "narration"], "left").filter(F.coalesce("whole", F.lit(0.0)) < 1.0)
             .withColumn("n", text.plain_text(F.col("narration"))))
    words = cut(open_.select(*keys, "narration", "n", "whole", F.explode(F.array_distinct(text.long_words(F.col("n")))).alias("a")))
    of_accounts = cut(chart.select(*keys, "coa_idx", F.explode(F.array_distinct(text.long_words(text.plain_text(F.col("name"))))).alias("b")))
    first = of_accounts.groupBy(*keys, "b").agg(F.min("coa_idx").alias("coa_idx"))
    pairs = best_words(words, first.select(*keys, "b"), keys, least).join(shuffled(first), [*keys, "b"])
    loud = F.col("score") > WORD_HELD
    choice = F.struct((-F.col("score")).alias("order"), "coa_idx", "b")
    kept = cut(pairs.groupBy(*keys, "a").agg(F.min(F.when(~loud, choice)).alias("one"), F.collect_set(F.when(loud, choice)).alias("more"))
               .select(*keys, "a", F.explode(F.array_compact(F.concat(F.array("one"), "more"))).alias("c")))
    score = F.when(F.col("n").contains(F.col("c.b")), F.lit(WORD_HELD)).otherwise(-F.col("c.order"))
    scored = (words.join(shuffled(kept), [*keys, "a"]).select(*keys, "narration", "whole", score.alias("score"), "c.coa_idx", "c.b")
              .filter(F.col("score") >= least))
    closer = (scored.filter(F.col("score") > F.col("whole")).drop("coa_idx").join(shuffled(of_accounts), [*keys, "b"])
              .join(shuffled(named.select(*keys, "narration", "coa_idx")), [*keys, "narration", "coa_idx"], "left_anti"))
    fields = [*keys, "narration", "score", "coa_idx"]
    candidates = (named.filter(F.col("score") >= least).select(*fields).union(scored.filter("whole is null").select(*fields))
                  .union(closer.select(*fields)))
    return _best_account(candidates, coa, "narration", keys)


def unclaimed_accounts(banks: DataFrame, coa: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Bank rows nobody claimed whose narration names an account that is not bank or cash."""
    parties = coa.filter(~text.is_bank_or_cash(F.col("account_type")))
    found = match_by_narration(banks, parties, options)
    return (banks.select("statement_id", "bank_idx", "narration")
            .join(shuffled(found), ["statement_id", "narration"]))


@dataclass
class _Wishes:
    """Which bank rows a name asks for: by names that stand whole in a narration, and by the words of names a narration names.

    Words that only resemble each other, under the score of a held word, make very many pairs. Just the names that find nothing
    better free need them, so they are looked up for those names alone (``further``).
    """

    whole: DataFrame  # lane, narration, name, score
    by_word: DataFrame  # lane, narration, b, score
    words: DataFrame  # lane, name, b
    said: DataFrame  # lane, narration, n, a
    complete: DataFrame | None  # lane, name: names with all they ask for
    lane: list[str]
    least: float

    @staticmethod
    def of(banks: DataFrame, leds: DataFrame, lane: list[str], least: float) -> _Wishes:
        names, narrations = leds.select(*lane, "name").distinct(), banks.select(*lane, "narration").filter("narration <> ''").distinct()
        narrations = cut(narrations.join(names.select(*lane).distinct(), lane, "left_semi"))
        n = text.plain_text(F.col("narration"))
        said = cut(narrations.select(*lane, "narration", n.alias("n"), F.explode(F.array_distinct(text.long_words(n))).alias("a")))
        words = cut(leds.select(*lane, "name", F.explode("words").alias("b")).distinct())
        near = close_words(said.select(*lane, "a"), words.select(*lane, "b"), lane, max(least, WORD_HELD))
        by_word = _Wishes._scored(said, near, lane).filter(F.col("score") >= least)
        return _Wishes(cut(named_whole(narrations, names, lane)), cut(by_word), words, said, None, lane, least)

    @staticmethod
    def _scored(said: DataFrame, pairs: DataFrame, lane: list[str]) -> DataFrame:
        score = F.when(F.col("n").contains(F.col("b")), F.lit(WORD_HELD)).otherwise(F.col("score"))
        return said.join(shuffled(pairs), [*lane, "a"]).groupBy(*lane, "narration", "b").agg(F.max(score).alias("score"))

    def further(self, free: DataFrame, names: DataFrame) -> None:
        """Look up all that names (lane, name) ask for among the free rows."""
        lane = self.lane
        names = names if self.complete is None else names.join(self.complete, [*lane, "name"], "left_anti")
        names = cut(names.select(*lane, "name").distinct())
        said = cut(self.said.join(shuffled(free.select(*lane, "narration")), [*lane, "narration"], "left_semi"))
        words = self.words.join(names, [*lane, "name"], "left_semi").select(*lane, "b").distinct()
        more = _Wishes._scored(said, _alike(said.select(*lane, "a"), words, lane, self.least), lane)
        self.by_word = cut(self.by_word.union(more).groupBy(*lane, "narration", "b").agg(F.max("score").alias("score")))
        self.complete = names if self.complete is None else cut(self.complete.union(names))

    def asking(self, rows: DataFrame) -> DataFrame:
        """Rows (lane, name, words) with whether their name has all it asks for."""
        if self.least >= WORD_HELD:
            return rows.withColumn("complete", F.lit(True))
        plain = F.size("words") == 0
        if self.complete is None:
            return rows.withColumn("complete", plain)
        known = self.complete.withColumn("known", F.lit(True))
        return rows.join(known, [*self.lane, "name"], "left").withColumn("complete", plain | F.col("known").isNotNull()).drop("known")

    def lists(self, free: DataFrame, turn: DataFrame, most: int) -> DataFrame:
        """lane, of_name, key, bank_idx, score: of every name and every word of the rows (lane, name, words) its best free bank rows.

        ``most`` of them, as no more rows take their turn. What a name asks for is the best of its own list and those of its words.
        """
        lane, rows = self.lane, free.select(*self.lane, "bank_idx", "narration")
        names, words = turn.select(*lane, "name").distinct(), turn.select(*lane, F.explode("words").alias("b")).distinct()
        by_word = self.by_word.join(words, [*lane, "b"], "left_semi")
        held = rows.join(shuffled(by_word.filter(F.col("score") <= CONTAINED)), [*lane, "narration"]).select(
            *lane, F.lit(False).alias("of_name"), F.col("b").alias("key"), "bank_idx", "score")
        # a name that stands whole in a narration is scored by that, even where one of its words is closer
        whole = self.whole.join(names, [*lane, "name"], "left_semi")
        louder = (by_word.filter(F.col("score") > CONTAINED).join(self.words.join(names, [*lane, "name"], "left_semi"), [*lane, "b"])
                  .join(whole.select(*lane, "name", "narration"), [*lane, "name", "narration"], "left_anti")
                  .groupBy(*lane, "narration", "name").agg(F.max("score").alias("score")))
        own = whole.filter(F.col("score") >= self.least).select(*lane, "narration", "name", "score").union(louder)
        named = rows.join(shuffled(own), [*lane, "narration"]).select(
            *lane, F.lit(True).alias("of_name"), F.col("name").alias("key"), "bank_idx", "score")
        place = Window.partitionBy(*lane, "of_name", "key").orderBy(F.desc("score"), "bank_idx")
        return held.union(named).withColumn("at", F.row_number().over(place)).filter(F.col("at") <= most).drop("at")


def _in_turn(leds: pa.Table, choices: pa.Table) -> pa.Table:
    """One lane: its rows choose in index order, each the best free bank row at the head of its name's list and those of its words.

    Nothing is final from the first row on that finds no bank row while its name may ask for more.
    """
    choices = choices.sort_by([("of_name", "ascending"), ("key", "ascending"), ("score", "descending"), ("bank_idx", "ascending")])
    banks, scores = choices["bank_idx"].to_pylist(), choices["score"].to_pylist()
    heads: dict[tuple[bool, str], list[int]] = {}  # place of the first choice that may be free, end
    for place, key in enumerate(zip(choices["of_name"].to_pylist(), choices["key"].to_pylist())):
        heads.setdefault(key, [place, place])[1] = place + 1
    taken, final, found = set(), True, {"led_idx": [], "bank_idx": [], "score": [], "final": [], "name": [], "asks": []}
    for row in leds.select(["led_idx", "name", "words", "complete"]).sort_by("led_idx").to_pylist():
        best = None
        for key in [(True, row["name"]), *((False, b) for b in row["words"])]:
            head = heads.get(key)
            if head is None:
                continue
            at, end = head
            while at < end and banks[at] in taken:
                at += 1
            head[0] = at
            if at < end and (best is None or (-scores[at], banks[at]) < best):
                best = (-scores[at], banks[at])
        asks = best is None and not row["complete"]
        final = final and not asks
        if best is not None:
            taken.add(best[1])
        for name, value in (("led_idx", row["led_idx"]), ("bank_idx", best and best[1]), ("score", best and -best[0]), ("final", final), ("name", row["name"]),
                            ("asks", asks)):
            found[name].append(value)
    n = len(found["led_idx"])
    lane = [(leds.schema.names[i], pa.array([leds.column(i)[0].as_py()] * n if n else [], leds.schema.types[i])) for i in (0, 1)]
    kinds = {"led_idx": pa.int64(), "bank_idx": pa.int64(), "score": pa.float64(), "final": pa.bool_(), "name": pa.string(), "asks": pa.bool_()}
    return pa.table(dict(lane) | {name: pa.array(values, kinds[name]) for name, values in found.items()})


def match_by_account_name(banks: DataFrame, leds: DataFrame, options: MatchOptions = MatchOptions(),
                          per_round: int = NAMES_PER_ROUND) -> DataFrame:
    """(statement_id, led_idx, bank_idx, score) for ledger rows that carry nothing but a name.

    Ledger rows choose in index order, each the free bank row of its direction that names it best. What a name asks for is
    found from the index. A round settles the next ``per_round`` rows of every (statement, direction): of n rows none can
    need more than its n best bank rows, so a round gathers lists of n at most, one a name and one a word. Its rows are replayed
    with what scores as much as a held word; from the first one on that finds nothing so, they are replayed again with all that
    the names that found nothing ask for, and once more, if that is not enough, with all that any name asks for.
    """
    lane = ["statement_id", "direction"]
    own_words = F.array_distinct(text.long_words(text.plain_text(F.col("name")))).alias("words")
    waiting = cut(leds.select(*lane, F.col("led_idx").cast("bigint").alias("led_idx"), F.col("account_name").alias("name")).filter("name <> ''")
                  .select("*", own_words))
    free = cut(banks.filter("direction is not null").select(*lane, F.col("bank_idx").cast("bigint").alias("bank_idx"), "narration"))
    kind = banks.schema["statement_id"].dataType.simpleString()
    out = f"statement_id {kind}, direction string, led_idx bigint, bank_idx bigint, score double, final boolean, name string, asks boolean"
    found, wishes = [], _Wishes.of(free, waiting, lane, options.fuzzy_threshold)
    while True:
        turn = cut(_next_turn(waiting, lane, per_round))
        if not has_rows(turn):
            break
        left, tries = turn, 0
        while True:
            chosen = cut(wishes.asking(left).select(*lane, "led_idx", "name", "words", "complete").groupBy(*lane)
                         .cogroup(wishes.lists(free, left, per_round).groupBy(*lane)).applyInArrow(_in_turn, out))
            found.append(chosen.filter("final and bank_idx is not null"))
            open_ = chosen.filter("not final")
            again = has_rows(open_)
            if again:
                free = cut(free.join(shuffled(found[-1].select(*lane, "bank_idx")), [*lane, "bank_idx"], "left_anti"))
                left = cut(left.join(shuffled(open_.select(*lane, "led_idx")), [*lane, "led_idx"], "left_semi"))
                wishes.further(free, open_.filter("asks") if tries == 0 else left)
                tries += 1
            else:
                break
        later = waiting.join(turn.select(*lane, "led_idx"), [*lane, "led_idx"], "left_anti")
        if not has_rows(later):
            break
        waiting, free = cut(later), cut(free.join(shuffled(found[-1].select(*lane, "bank_idx")), [*lane, "bank_idx"], "left_anti"))
    if not found:
        return free.limit(0).select("statement_id", F.lit(0).cast("bigint").alias("led_idx"), "bank_idx",
                                    F.lit(0.0).alias("score"))
    return reduce(DataFrame.union, found).select("statement_id", "led_idx", "bank_idx", "score")


def _next_turn(waiting: DataFrame, lane: list[str], size: int) -> DataFrame:
    """The ``size`` waiting rows of lowest index in every lane; first cut per chunk of indexes."""
    chunk = Window.partitionBy(*lane, F.floor(F.col("led_idx") / BLOCK)).orderBy("led_idx")
    near = waiting.withColumn("_at", F.row_number().over(chunk)).filter(F.col("_at") <= size)
    low = (near.groupBy(*lane, F.floor(F.col("led_idx") / BLOCK).alias("_chunk"))
           .agg(F.count("*").alias("_n")))
    before = Window.partitionBy(*lane).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = low.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_shift") < size)
    return (near.withColumn("_chunk", F.floor(F.col("led_idx") / BLOCK))
            .join(shift.select(*lane, "_chunk", "_shift"), [*lane, "_chunk"])
            .filter(F.col("_shift") + F.col("_at") <= size)
            .drop("_chunk", "_at", "_shift"))
