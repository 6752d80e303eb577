"""How well two hits fit as pieces of one element, by class: expressions over rows that hold both hits.

A row has the columns of the left hit under `l_` and of the right one under `r_` (name, type, orientation, query_start,
query_end, subj_start, subj_end, subj_remaining, score, div (percent), stage, masked), and `distance`, `ltr_distance`: how
many elements, or LTR elements, lie from one to the other, 1 for neighbours. A score is null where any of these is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import scalar as S
from strandloom.operators.chain import ranked

# Names of long terminal repeats of one class that may belong to one element, as pairs of patterns
LTR_NAME_PAIRS = [
    ("^THE1", "THE1|MST[AB-]"),
    ("^MST", "THE1[BC-]|MST|MLT1[AB-]"),
    ("^MLT-int", "THE1C|MST[ABCD]|MLT1[ABC]"),
    ("^MLT1[A-]", "MST[CD-]|MLT1[ABC-]"),
    ("^MLT1F", "MLT1[DEFGHIJKL]"),
    ("MLT1[B-H]", "MLT1"),
    ("^ORR1", "^ORR1|^MT"),
    ("^MT", "^MT|^ORR1"),
]


def l(name: str) -> Column:  # noqa: E743
    return F.col(f"l_{name}")


def r(name: str) -> Column:
    return F.col(f"r_{name}")


def query_shared() -> Column:
    return S.query_overlap(l("query_start"), l("query_end"), r("query_start"), r("query_end"))


def consensus_shared() -> Column:
    return S.consensus_gap(l("orientation"), l("subj_start"), l("subj_end"), r("subj_start"), r("subj_end"))


def one_strand() -> Column:
    return l("orientation") == r("orientation")


def _fits(most: int = 21) -> Column:
    """Pieces that share little of the consensus, or little more than they share of the query."""
    q, c = query_shared(), consensus_shared()
    return (c >= -100) & ((c <= most) | ((q > 0) & (c - q <= 20)))


def _most_gap(reach: int) -> Column:
    """Consensus bases that may lie between: fewer for unlike divergence and for more elements in between."""
    same = F.when(l("name") == r("name"), 1.5).otherwise(1.0)
    return 2500 * same * (10 - F.abs(l("div") - r("div"))) / 10 * (reach - F.col("distance")) / reach


def stem(name: Column, alu: bool | Column = False) -> Column:
    """A family's name without the letter of its subfamily; where `alu` holds, of an Alu the first five characters."""
    plain = F.regexp_replace(name, r"(\S+\d)[a-zA-Z]$", "$1")
    if alu is False:
        return plain
    return F.when(name.rlike("^Alu") & (F.lit(alu) if isinstance(alu, bool) else alu), F.regexp_replace(name, r"^(\w{5}).*", "$1")).otherwise(plain)


def generic_score(alu: bool | Column = False, right_stem: Column | None = None) -> Column:
    """1: close pieces of like names found in one stage; 0.5: the left name begins with the right one's stem, in reach; else 0."""
    like = l("name").contains(r("name")) | r("name").contains(l("name"))
    close = (l("stage") == r("stage")) & like & (query_shared() >= -10) & _fits()
    c = consensus_shared()
    loose = l("name").startswith(stem(r("name"), alu) if right_stem is None else right_stem) & (c < 33) & (c > -_most_gap(15))
    return F.when(~one_strand(), 0.0).when(close, 1.0).when(loose, 0.5).otherwise(0.0)


def sine_score() -> Column:
    return generic_score(alu=True)


def refined_sine_score() -> Column:
    """Both scores' sum over the distance and the step in the query, for pieces of one name; else 0."""
    q = query_shared()
    step = r("query_start") - l("query_end")
    score = (l("score") + r("score")) / F.col("distance") / F.when(step == 0, 1).otherwise(step)
    return F.when((l("name") == r("name")) & one_strand() & (q <= 21) & (q >= -1000) & _fits(), score).otherwise(0.0)


def ltr_stem(name: Column) -> Column:
    """The part of an LTR family's name that its relatives share."""
    to = lambda n: F.regexp_replace(name, rf"^(\w{{{n}}}).*", "$1")
    return F.when(name.rlike(r"^(MER|LTR)\d{2}"), to(5)).when(name.rlike(r"^(MER|LTR)\d[A-Z_a-z]|ORR1"), to(4)).otherwise(F.regexp_replace(name, r"(\S+\d)[-a-zA-Z].*", "$1"))


def ltr_sides(name: Column) -> tuple[Column, Column]:
    """Bits of the LTR_NAME_PAIRS whose first, and whose second pattern a name has."""
    bits = lambda side: F.lit(0).bitwiseOR(sum((F.when(name.rlike(p[side]), 1 << k).otherwise(0) for k, p in enumerate(LTR_NAME_PAIRS)), F.lit(0)))
    return bits(0), bits(1)


def ltr_names_fit(left: tuple[Column, Column] | None = None, right: tuple[Column, Column] | None = None, right_stem: Column | None = None) -> Column:
    """1: of one class and stem; 0.5: of one class, and of those that mix only as LTR_NAME_PAIRS say; else 0.

    What goes by one name alone may be given where it is known: ltr_sides() of both and the right one's ltr_stem().
    """
    (la, lb), (ra, rb) = left or ltr_sides(l("name")), right or ltr_sides(r("name"))
    listed = (la.bitwiseAND(rb) != 0) | (ra.bitwiseAND(lb) != 0)
    some = ~l("type").contains("ERVL-MaLR") | listed
    return F.when(l("type") != r("type"), 0.0).when(l("name").contains(ltr_stem(r("name")) if right_stem is None else right_stem), 1.0).when(some, 0.5).otherwise(0.0)


def _free_ends(least: int | None = None, most: int | None = None) -> Column:
    """Whether the inner ends lack at least, or at most, so many bases of the consensus."""
    test = (lambda x: x >= least) if least is not None else (lambda x: x <= most)
    plus = (l("orientation") == "+") & test(l("subj_remaining")) & test(r("subj_start"))
    return plus | ((r("orientation") == "C") & test(l("subj_start")) & test(r("subj_remaining")))


def ltr_score(names: Column | None = None, internal: tuple[Column, Column] | None = None) -> Column:
    """1, 0.5 or 0.25 by how strictly the pair fits, and then 1 / distance more; 0 if it doesn't.

    `names` and `internal` may be given where they are known: the names' fit, and whether each is an internal part.

    Two internal parts go by the consensus between them, two LTRs by their open ends too, and an LTR beside an internal
    part by closed ends and few elements between; then pairs of one stem within reach; then those that overlap by 12 or 33.
    """
    names, c = ltr_names_fit() if names is None else names, consensus_shared()
    a, b = internal or (S.is_internal(l("name")), S.is_internal(r("name")))
    masked = l("masked") & r("masked")
    same = l("name") == r("name")
    internal = (c <= 111) & ((c >= -1234) | (same & (c >= -5555)))
    kin = (l("type").contains("ERVL-MaLR") & r("type").contains("ERVL-MaLR")) | (l("name").contains("MLT2") & r("name").contains("MLT2")) | (names == 1)
    ends = kin & masked & (c > -(220 - F.col("ltr_distance") * 20)) & (c <= 50) & _free_ends(least=10)
    mixed = (F.col("distance") <= 2) & (query_shared() > -350) & _free_ends(most=33)
    strict = F.when(a & b, internal).when(~a & ~b, ends).otherwise(mixed)
    loose = (names == 1) & (c > -_most_gap(10)) & ((a != b) | ((c < 33) & masked))
    over = l("query_end") - r("query_start")
    tucked = (over >= 0) & (r("query_end") > l("query_end")) & (((names == 1) & (over >= 12)) | (over >= 33))
    score = F.when((names == 0) | ~one_strand(), None).when(strict, 1.0).when(loose, 0.5).when(tucked, 0.25)
    return F.coalesce(score + 1 / F.col("distance"), F.lit(0.0))


def line_stem(name: Column) -> Column:
    """The part of a LINE family's name that its relatives share; first without marks of its pieces."""
    plain = line_plain(name)
    return F.when(plain.rlike("^L1M"), F.regexp_replace(plain, r"^(\w{5}).*", "$1")).otherwise(F.regexp_replace(plain, r"(\S+\d)[a-zA-Z]$", "$1"))


def line_plain(name: Column) -> Column:
    """A LINE family's name without marks of its pieces; of some carnivore families the name they stand for."""
    # Marks, and names that stand for others
    plain = name
    for mark, to in ((r"_orf2$", ""), (r"^(.*)_[35]endX?$", "$1"), (r"_strong$", "")):
        plain = F.regexp_replace(plain, mark, to)
    for mark, to in (("^L1_Canis0", "L1_Cf"), ("^L1_Canis4", "L1_Canid"), ("^L1_Canis5", "L1_Canid2")):
        plain = F.regexp_replace(plain, mark, to)
    return plain


def line_kin() -> Column:
    return line_plain(l("name")).startswith(line_stem(r("name")))


def line_score(distance: Column, kin: Column | None = None) -> Column:
    """How well two pieces of LINEs fit; needs `names_fit` of line_names_fit() and the right hit's query_remaining.

    1: names fit, the consensus goes on, no piece of a 3' end comes before what lies 5' of it, and the consensus between or
    shared is within what the part not aligned yet, the distance and the likeness of divergence allow: near the 5' end much
    more than near the 3' end. 0.5: like names within reach. 0.25: like names that share 34 bases of the query or more.
    Then the less the pieces share or leave of the consensus, the more is added.
    """
    q, c = query_shared(), consensus_shared()
    beyond = F.when(q > 0, c - q).otherwise(c)
    a, b = l("div"), r("div")
    low, high = F.least(a, b), F.greatest(a, b)
    like = F.least(F.lit(1.2), F.when((a != b) & (high > 0), low / high / 0.65 - (high - low) / 100).otherwise(1.2))
    near = 1 - (distance - 1) / 30
    left = F.greatest(l("subj_remaining"), r("subj_remaining")).cast("double")
    onward = ((l("orientation") == "+") & (r("subj_start") >= l("subj_start") - 5)) | ((l("orientation") == "C") & (l("subj_start") >= r("subj_start") - 5))
    end3, end5 = (lambda x: x.contains("_3end")), (lambda x: x.contains("_5end"))
    closed = ((l("orientation") == "+") & end3(l("name")) & (end5(r("name")) | (l("subj_remaining") < 10))) | ((r("orientation") == "C") & end3(r("name")) & (end5(l("name")) | (r("query_remaining") < 10)))
    shares = (beyond == 0) | (beyond <= (3.75 * F.pow(left, 0.48) - 47) * near * near * like)
    strict = F.col("names_fit") & onward & ~closed & shares & (like > 0.1) & (-c <= near * like * left / 1.4)
    kin = line_kin() if kin is None else kin
    reach = 2500 * F.when(l("name") == r("name"), 1.5).otherwise(1.0) * (10 - F.abs(a - b)) / 10 * (10 - distance) / 10
    tucked = (l("query_end") >= r("query_start")) & (r("query_end") > l("query_end")) & kin & (r("query_start") <= l("query_end") - 33) & (c < 50)
    score = F.when(~one_strand(), None).when(strict, 1.0).when(kin & (c < 33) & (c > -reach), 0.5).when(tucked, 0.25)
    step = F.abs(beyond + q)
    return F.coalesce(score + F.when(step != 0, 1 / step).otherwise(1 / distance), F.lit(0.0))


def transposons_fit() -> Column:
    """Whether two pieces of a DNA transposon may be one: by the consensus between them, on the minus strand alone."""
    gap = l("subj_start") - r("subj_end")
    beyond = r("subj_end") - r("subj_start") + 1 - gap
    return (l("orientation") == "C") & (gap > -75) & (gap < 500) & (l("subj_start") - beyond > -10)


def congruous() -> Column:
    """One subject and strand, and steps in subject and query that differ by less than 7000."""
    subject = F.when(l("orientation") == "C", l("subj_start") - r("subj_end")).otherwise(r("subj_start") - l("subj_end"))
    return (l("name") == r("name")) & one_strand() & (F.abs(subject - (r("query_start") - l("query_end"))) < 7000)


def line_names_fit(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """pairs with names_fit: equal names, or a row (name_a, name_b, threshold) of `allowed`, in either order, this one first.

    A threshold of 0 always allows, a positive one where the pair shares more of the query, a negative one never. `allowed`
    has one row for a pair of names, and goes to every task.
    """
    as_is = allowed.select(F.col("name_a").alias("l_name"), F.col("name_b").alias("r_name"), F.col("threshold").alias("__t1"))
    turned = allowed.select(F.col("name_b").alias("l_name"), F.col("name_a").alias("r_name"), F.col("threshold").alias("__t2"))
    both = pairs.join(F.broadcast(as_is), ["l_name", "r_name"], "left").join(F.broadcast(turned), ["l_name", "r_name"], "left").withColumn("__t", F.coalesce("__t1", "__t2"))
    listed = (F.col("__t") == 0) | ((F.col("__t") > 0) & (query_shared() > F.col("__t")))
    return both.withColumn("names_fit", F.coalesce((l("name") == r("name")) | listed, F.lit(False))).drop("__t", "__t1", "__t2")


#: Columns of a hit that a pair holds.
SIDES = {
    "id": "hit_id", "name": "subj_name", "type": "subj_type", "orientation": "orientation", "query_start": "query_start", "query_end": "query_end",
    "subj_start": "subj_start", "subj_end": "subj_end", "subj_remaining": "subj_remaining", "score": "score", "stage": "stage", "masked": "masked", "div": "div",
}


def pairs(hits: DataFrame, ahead: int = 4, sides: dict[str, str] = SIDES, order: list[Column] | None = None) -> DataFrame:
    """Every hit with each of the next `ahead` ones of its sequence, as rows of both, with distance and ltr_distance.

    hits needs `div` (percent) and `masked` beside its other columns. A hit is in 2 * ahead pairs at most, whatever the
    sequence's size. ltr_distance counts the steps over hits of LTR classes. `order`: of a sequence's hits, by_position() if not given.
    """
    so_far = Window.partitionBy("query_name").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked(hits, order).withColumn("ltrs", F.count(F.when(F.col("subj_type").startswith("LTR"), 1)).over(so_far))
    first = placed.select("query_name", "rank", "ltrs", *[F.col(c).alias(f"l_{k}") for k, c in sides.items()])
    second = placed.select("query_name", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("distance"), F.col("rank").alias("__r"), F.col("ltrs").alias("__n"), *[F.col(c).alias(f"r_{k}") for k, c in sides.items()])
    second = second.withColumn("rank", F.col("__r") - F.col("distance")).where("rank > 0")
    return first.join(second, ["query_name", "rank"]).withColumn("ltr_distance", F.col("__n") - F.col("ltrs")).drop("__r", "__n", "ltrs", "rank")
