"""Personal data: fixed patterns as seeds, bootstrapped context patterns beyond them (DataFrame operations only).

Regular expressions find the seeds. Every token that looks like an identifier
(it holds a digit or an at sign) is an instance, and so is every row of adjacent
numbers that has as many digits as a phone or card; the word before it, alone
and together with its rough shape, and its exact shape are the lexical patterns
around it.
Instances and patterns form a bipartite graph: a pattern is as good as its
instances, an instance as good as its patterns, seeds are certain. Some rounds
of scoring over that graph leave patterns of high confidence, and tokens that
stand in them without being seeds are reported too, if they obey the law of
their kind (check digits of cards, ranges of addresses, digits of numbers). That
reaches what no fixed pattern does: phones without a plus, addresses with other
marks between their parts, mail without a domain, and secrets, whose seeds are
what is assigned to a token, key or password.

Scale. Texts are read once and never shuffled; the graph has a row for each
distinct pair of pattern and instance, counted on the map side first. All
regular expressions are linear in the text: runs are matched possessively and
only from their beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join

#: The order of kinds in results; the last has no fixed pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
FIXED, SECRET = 4, 4

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run starts after another character or where the match before it ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Numbers one space apart, whole words but for punctuation after them.
_NUMBER = r"[+(]*+[0-9][0-9().+-]*+(?![\p{L}\p{N}_@/=])"
RUN = rf"(?<!\S){_NUMBER}(?: {_NUMBER})++"
NUMBER = r"^[+(]*[0-9][0-9 ().+-]*$"
#: A name and what is assigned to it, without a space: the name is the word before.
_NAME = r"^([\p{L}][\p{L}_.-]*+[=:])[\"'`(<]*"
#: The names that seed secrets.
_NAMES = "token secret password passwd pwd key apikey bearer credential credentials".split()
SECRET_BEFORE = r"(?:^|[^\p{L}])(?:" + "|".join(_NAMES) + r") ?[=:]*$"
SECRET_OK = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=.~-]{8,}$"
SECRET_SEED = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{16,}$"
#: Addresses as they are written to be no links: other marks between the parts, or of the sixth version.
IP_LIKE = r"^[0-9]{1,3}(?:[^0-9\p{L}\s]{1,3}[0-9]{1,3}){3}$"
IP_SIX = r"^(?=.*::|(?:[^:]*:){7})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$"

ROUNDS = 3
CONFIDENCE = 0.9
SEEDS = 5  # distinct seeds that a pattern needs
RUN_TOKENS = 8  # an identifier that is written in groups: at most 19 digits
STEP = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def located(text: Column, regex: str, before: bool = False) -> Column:
    """All matches as array of (start, end, text[, two words before]), in code points.

    The parts between the matches and the matches themselves make up the text,
    so running sums of their lengths are the places; sums are taken in steps so
    that thousands of matches in one text cost no square of their number.
    """
    parts = F.split(text, regex, -1)
    fields = [F.transform(parts, F.length).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit")]
    if before:
        word = lambda p: F.substring_index(F.rtrim(F.translate(p, "\n\t\r\f\v", "     ")), " ", -2)
        fields.append(F.transform(parts, word).alias("word"))

    def places(s: Column) -> Column:
        widths = F.transform(s["hit"], lambda x, i: F.get(s["gap"], i) + F.length(x))

        def steps(w: Column) -> Column:
            starts = F.sequence(F.lit(0), F.shiftright(F.size(w), 6))
            return F.transform(starts, lambda b: _sum(F.slice(w, b * STEP + 1, STEP)))

        def bases(t: Column) -> Column:
            return F.transform(t, lambda _, b: _sum(F.slice(t, 1, b)))

        def place(w: Column, base: Column, x: Column, i: Column) -> Column:
            b = F.shiftright(i, 6)
            start = F.get(base, b) + _sum(F.slice(w, b * STEP + 1, i % STEP)) + F.get(s["gap"], i)
            out = [start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text")]
            return F.struct(*out, F.get(s["word"], i).alias("word")) if before else F.struct(*out)

        return _let(
            widths,
            lambda w: _let(
                steps(w), lambda t: _let(bases(t), lambda base: F.transform(s["hit"], lambda x, i: place(w, base, x, i)))
            ),
        )

    return _let(F.struct(*fields), places)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _is_ip(x: Column) -> Column:
    return x.rlike(IP_OK)


def _is_ip_like(x: Column) -> Column:
    return (x.rlike(IP_LIKE) & _is_ip(F.regexp_replace(x, "[^0-9]+", "."))) | x.rlike(IP_SIX)


def _is_card(x: Column) -> Column:
    return F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))


def _is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(10, 15)


_FINDERS = (
    (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True)),
    (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _is_ip),
    (CARD, lambda t: t.rlike("[0-9][ -]?[0-9]"), _is_card),
    (PHONE, lambda t: t.rlike(r"\+[0-9]"), _is_phone),
)


def _found(text: Column, regex: str, good: Callable[[Column], Column], kind: int) -> Column:
    hits = F.filter(located(text, regex), lambda h: good(h["text"]))
    return F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kind).alias("kind"), h["end"].alias("end"))
    )


def base_spans(text: Column) -> Column:
    """array of (start, kind number, end) of the fixed kinds, sorted."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = [
        F.when(maybe(text), _found(text, regex, good, n)).otherwise(none) for n, (regex, maybe, good) in enumerate(_FINDERS)
    ]
    return F.array_sort(F.concat(*each))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _shape(x: Column, exact: bool) -> Column:
    """Digits as 9 and letters as a; runs of one only where the shape is rough."""
    many = "" if exact else "+"
    return F.regexp_replace(F.regexp_replace(x, "[0-9]" + many, "9"), r"\p{L}" + many, "a")


def _word(before: Column) -> Column:
    """The word before, with the one before that if it has no letters; in lower case."""
    last = F.substring_index(before, " ", -1)
    return F.lower(F.when(last.rlike(r"\p{L}") | ~before.rlike(r"\p{L}"), last).otherwise(F.regexp_replace(before, " +", " ")))


def _runs(run: Column) -> Column:
    """Of a run of numbers every row of 2 to ``RUN_TOKENS`` with the digits of a phone or card, as (start, end, text, word)."""

    def rows(parts: Column) -> Column:
        def row(i: Column, n: Column) -> Column:
            last = F.get(parts, i + n - 1)
            text = F.concat_ws(" ", F.transform(F.slice(parts, i + 1, n), lambda p: p["text"]))
            core = F.regexp_replace(text, "[^0-9]+$", "")
            return F.struct(
                (run["start"] + F.get(parts, i)["start"]).alias("start"),
                (run["start"] + last["end"] - F.length(text) + F.length(core)).alias("end"),
                core.alias("text"),
                F.when(i == 0, run["word"]).otherwise(F.get(parts, i - 1)["text"]).alias("word"),
            )

        most = lambda i: F.least(F.lit(RUN_TOKENS), F.size(parts) - i)
        every = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.transform(F.sequence(F.lit(2), most(i)), lambda n: row(i, n))
        )
        return F.filter(F.flatten(every), lambda r: F.length(_digits(r["text"])).between(10, 19))

    return _let(located(run["text"], "[^ ]+"), rows)


def _apart(spans: Column) -> Column:
    """Of (start, -trust, end, kind) those that begin where the one taken before has ended."""

    def step(a: Column, x: Column) -> Column:
        free = x["start"] >= a["at"]
        return F.struct(
            F.when(free, x["end"]).otherwise(a["at"]).alias("at"),
            F.when(free, F.concat(a["taken"], F.array(x))).otherwise(a["taken"]).alias("taken"),
        )

    none = F.struct(F.lit(0).alias("at"), F.filter(spans, lambda _: F.lit(False)).alias("taken"))
    taken = F.aggregate(spans, none, step, lambda a: a["taken"])
    return F.when(F.exists(F.transform(spans, lambda x, i: F.get(spans, i - 1)["end"] > x["start"]), lambda b: b), taken).otherwise(spans)


def score_patterns(edges: DataFrame, rounds: int, seeds: int, scratch: Scratch) -> DataFrame:
    """(pattern, kind, trust, uses) from (token, pattern, seed, uses), each pair of token and pattern once.

    A pattern is as good as its instances on average, less what few instances
    leave open; an instance that is no seed is as good as its best pattern, and
    never certain. Patterns need ``seeds`` distinct seeds of their kind. Joins
    on a pattern that very many instances have are dealt over salts.
    """
    certain = edges.where("seed is not null").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    certain = scratch.save(certain, "seeds")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.sum("uses").alias("uses"))
    scores = certain
    for n in range(rounds):
        good = edges.select("token", "pattern").join(scores, "token").groupBy("pattern", "kind").agg(
            F.sum("score").alias("sum"), F.count_if(F.col("score") == 1.0).alias("sure")
        )
        good = good.where(F.col("sure") >= seeds).join(sizes, "pattern")
        good = good.select("pattern", "kind", (F.col("sum") / (F.col("size") + 0.5)).alias("trust"), "size", "uses")
        good = scratch.save(good.where("trust >= 0.05"), f"patterns{n}")
        if n < rounds - 1:
            new = salted_join(edges.where("seed is null").select("token", "pattern"), good, "pattern", "size", "token")
            new = new.groupBy("token", "kind").agg(F.least(F.max("trust"), F.lit(0.99)).alias("score"))
            scores = scratch.save(certain.unionByName(new), f"scores{n}")
    return good


def _lawful(token: Column, kind: Column, pattern: Column) -> Column:
    """Whether a token that stands where a kind stands can be one."""
    alone = pattern.startswith("before ")
    return (
        ((kind == 0) & (~alone | token.contains("@")))
        | ((kind == 1) & (_is_ip(token) | _is_ip_like(token)))
        | ((kind == 2) & token.rlike("^[0-9 -]+$") & _is_card(token))
        | ((kind == 3) & _is_phone(token) & ((~alone & ~token.contains(" ")) | token.rlike(NUMBER)))
        | ((kind == SECRET) & token.rlike(SECRET_OK))
    )


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    seeds: int = SEEDS,
) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_learnt.

    Counts of the four kinds and the digest are of the fixed patterns; ``spans``
    lists those and what the learnt patterns add, as kind:start:end by start and
    kind, joined by commas. Secrets (what is assigned to a token, key or
    password, and what looks like it or stands like it) are a kind of their own,
    after the others. n_secret counts them, n_learnt all that was added. Offsets
    are code points, ends exclusive. Null and empty texts have no spans.
    Repeated rows and rows without an id each get their row; extra columns of
    any name are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    spans = base_spans(F.col("text"))
    tokens = F.when(F.col("text").rlike("[0-9@]"), located(F.col("text"), TOKEN, before=True))
    runs = F.when(F.col("text").rlike(r"[0-9][().+-]* [+(]*[0-9]"), located(F.col("text"), RUN, before=True))
    found = rows.select("rid", "id", spans.alias("base"), tokens.alias("tokens"), runs.alias("runs"))
    found = scratch.save(found, "found")

    # a name that is assigned to is the word before; other punctuation around a token is no part of the instance
    lead, trail = r"^[^\p{L}0-9+]+", r"[^\p{L}0-9]+$"
    inst = found.where("tokens is not null").select("rid", "base", F.explode("tokens").alias("t"))
    core = F.regexp_replace(F.col("t.text"), trail, "")
    name = F.regexp_extract(core, _NAME, 1)
    short = F.regexp_replace(F.when(name != "", F.regexp_replace(core, _NAME, "")).otherwise(core), lead, "")
    inst = inst.select(
        "rid",
        "base",
        (F.col("t.start") + F.length(core) - F.length(short)).alias("start"),
        (F.col("t.start") + F.length(core)).alias("end"),
        short.alias("token"),
        F.when(name != "", F.lower(name)).otherwise(_word(F.col("t.word"))).alias("word"),
    )
    # what is shorter obeys the law of no kind: an address has 7 characters, a secret 8
    inst = inst.where(F.col("token").contains("@") | (F.length("token") >= 7))
    inside = F.filter("base", lambda b: (b["start"] >= F.col("start")) & (b["end"] <= F.col("end")))
    touched = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    kind = F.get(F.transform(inside, lambda b: b["kind"]), F.lit(0))
    secret = ~touched & F.col("word").rlike(SECRET_BEFORE) & F.col("token").rlike(SECRET_SEED)
    cols = ["rid", "start", "end", "token", "word"]
    inst = inst.select(*cols, F.coalesce(kind, F.when(secret, F.lit(SECRET))).alias("seed"), touched.alias("touched"))
    # a row of numbers is a seed if it is a fixed match, and none if it holds only a part of one or more than one
    many = found.where("size(runs) > 0").select("rid", "base", F.explode("runs").alias("run"))
    many = many.select("rid", "base", F.explode(_runs(F.col("run"))).alias("t"))
    many = many.select("rid", "base", "t.start", "t.end", F.col("t.text").alias("token"), _word(F.col("t.word")).alias("word"))
    same = F.exists("base", lambda b: (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    many = many.where(same | ~touched).select(*cols, kind.alias("seed"), touched.alias("touched"))
    token, word = F.col("token"), F.col("word")
    # of what has letters and digits the alphabet and the length, since its exact shape is its own
    mixed = token.rlike(SECRET_SEED)
    alphabet = F.when(token.rlike("^[0-9a-f]+$"), "hex ").when(token.rlike("^[0-9A-Za-z]+$"), "letters and digits ").otherwise("marks too ")
    patterns = F.array(
        F.concat(F.lit("word "), word, F.lit(" "), _shape(token, False)),
        F.when(mixed, F.concat(F.lit("made of "), alphabet, F.length(token))).otherwise(F.concat(F.lit("shape "), _shape(token, True))),
        F.when(word.rlike(r"\p{L}") & ~word.rlike("[0-9]"), F.concat(F.lit("before "), word)),
    )
    inst = inst.unionByName(many).withColumn("patterns", F.array_compact(patterns)).drop("word")
    inst = scratch.save(inst, "instances")
    edges = inst.select("token", "seed", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("token", "pattern").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("uses"))
    edges = scratch.save(edges, "edges")
    good = score_patterns(edges, rounds, seeds, scratch)
    sure = scratch.save(good.where(F.col("trust") >= confidence), "sure")
    more = inst.where(~F.col("touched")).select("rid", "start", "end", "token", F.explode("patterns").alias("pattern"))
    # what is found by its surroundings must still obey the law of its kind
    more = salted_join(more, sure, "pattern", "uses", "rid").where(_lawful(token, F.col("kind"), F.col("pattern")))
    own = inst.where(F.col("seed") == SECRET).select("rid", "start", "end", F.lit(1.0).alias("trust"), F.lit(SECRET).alias("kind"))
    more = more.select("rid", "start", "end", "trust", "kind").unionByName(own)
    more = more.groupBy("rid", "start", "end").agg(F.max(F.struct("trust", (-F.col("kind")).alias("less"))).alias("best"))
    # as long as the document's list of tokens at most
    span = F.struct("start", (-F.col("best.trust")).alias("less"), "end", (-F.col("best.less")).alias("kind"))
    more = more.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("more")).select("rid", _apart(F.col("more")).alias("more"))
    more = more.select("rid", F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("more"))
    more = scratch.save(more, "more")
    count = lambda k, of: F.size(F.filter(of, lambda b: b["kind"] == k)).cast("long")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    out = found.select("rid", "id", "base").join(more, "rid", "left").select(
        F.col("id").alias(id_col),
        *[count(i, "base").alias(f"n_{k}") for i, k in enumerate(KINDS[:FIXED])],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.coalesce(count(SECRET, "more"), F.lit(0)).alias("n_secret"),
        F.coalesce(F.size("more").cast("long"), F.lit(0)).alias("n_learnt"),
    )
    return scratch.finish(out)
