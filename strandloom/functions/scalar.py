"""Scalar functions over hits and sequences, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters of nucleotides and their complements (IUPAC).
LETTERS, COMPLEMENT = "ACGTRYKMSWBDHVN", "TGCAYRMKSWVHDBN"
#: The same as some library writers have it: S and W swapped.
LEGACY_COMPLEMENT = "TGCAYRMKWSVHDBN"


def revcomp(s: Column, legacy: bool = False) -> Column:
    to = LEGACY_COMPLEMENT if legacy else COMPLEMENT
    return F.reverse(F.translate(s, LETTERS + LETTERS.lower(), to + to.lower()))


def gc_label(gc: Column) -> Column:
    """Background label of a GC percentage: odd numbers 35 to 53, with a g."""
    return F.concat(F.greatest(F.lit(35), F.least(F.lit(53), 35 + 2 * F.ceil((gc - 36) / 2))).cast("int").cast("string"), F.lit("g"))


def gc_or_default(gc: Column, n_sequences: Column, length: Column) -> Column:
    """The measured percentage, or 43 for several sequences or short ones."""
    return F.when((n_sequences > 1) | (length <= 2000), F.lit(43)).otherwise(gc)


def by_speed(options: list[str], speed: Column) -> Column:
    """Of four settings the one for slow (s), default, quick (q) or rush (qq)."""
    return F.element_at(F.array(*map(F.lit, options)), F.when(speed == "s", 1).when(speed == "q", 3).when(speed == "qq", 4).otherwise(2))


def query_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases that both ranges share; negative: bases between them."""
    return F.least(e1, e2) - F.greatest(s1, s2) + 1


def consensus_gap(orientation: Column, l_start: Column, l_end: Column, r_start: Column, r_end: Column) -> Column:
    """Consensus bases that two neighbours share, by strand."""
    return F.when(orientation == "C", r_end - l_start + 1).otherwise(l_end - r_start + 1)


def overlap_size(s1: Column, e1: Column, s2: Column, e2: Column, legacy: bool = False) -> Column:
    """Shared bases, 0 if none. `legacy`: also 0 where the first range holds the second strictly inside."""
    true = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return F.when((s1 < s2) & (e1 > e2), F.lit(0)).otherwise(true) if legacy else true


def too_diverged(past: Column, current: Column) -> Column:
    return (past > 2 * current) & (past > current + 10)


def rebased(div: Column, ins: Column) -> Column:
    """Divergence of the aligned part: 100 * div / (100 - ins), or div from 100 % insertions on."""
    return F.when(ins < 100, div * 100 / (100 - ins)).otherwise(div)


def translated(begin: Column, end: Column, start: Column, stop: Column, eq_start: Column, eq_stop: Column) -> tuple[Column, Column]:
    """A range of one consensus in an equivalent one: cut to [start, stop], scaled by the lengths of both ranges, whole numbers towards 0."""
    scaled = lambda x: ((x - start) * (eq_stop - eq_start + 1) / (stop - start + 1) + eq_start).cast("long")
    return scaled(F.greatest(begin, start)), scaled(F.least(end, stop))


def sanitized(name: Column) -> Column:
    """A name as a key: runs of white space, commas and underscores to one underscore, brackets and quotes out."""
    return F.regexp_replace(F.regexp_replace(name, r"[\s,_]+", "_"), r"[()<>']+", "")


def accession_bin(accession: Column) -> Column:
    """Bins of an accession as a path: DF or DR and three pairs of digits, else Aux and the first two letters in lower case."""
    # Fixed value: accessions of two letters and 9 to 12 digits
    parts = [F.regexp_extract(accession, "^(D[FR])([0-9]{2})([0-9]{2})([0-9]{2})[0-9]{3,6}$", k) for k in range(1, 5)]
    return F.when(parts[0] != "", F.concat_ws("/", F.lit("Families"), *parts)).otherwise(F.concat(F.lit("Families/Aux/"), F.lower(F.substring(accession, 1, 2))))


def is_internal(name: Column) -> Column:
    """Whether a family's name is that of the inside of an endogenous retrovirus, not of its long terminal repeats."""
    # Parts of such names
    inside = name.rlike("(?i)int|ERV|PRIMA41|Harlequin|HUERS") | name.rlike(r"[-_]I(_\S+)?$") | name.rlike("MMERGLN|MMURS|MMVL30|MULV|MURVY|ETn|^IAP")
    return (~name.contains("LTR") | name.rlike("int$")) & inside


def is_ltr(name: Column) -> Column:
    return ~is_internal(name)


# Lambda and mu by period of tandem repeats, and the copies that must be exceeded
YOUNG_TANDEM = (0.41, (8.51, 1.04, 6.26, 8.65, 10.36, 7.19, 8.81, 10.84, 12.97, 15.07), 4)
OLD_TANDEM = (0.32, (0.79, 1.00, 4.78, 6.94, 8.68, 9.84, 11.94), 5)


def tandem_kept(copies: Column, score: Column, young: bool) -> Column:
    """Tandem repeats of more than 4 (young) or 5 copies whose score by matrix is 20 or more."""
    return (copies > (YOUNG_TANDEM if young else OLD_TANDEM)[2]) & (score >= 20)


def tandem_bits(score: Column, period: Column, young: bool) -> Column:
    """Whole bits of a tandem repeat's score; null for periods beyond the table."""
    lam, mu, _ = YOUNG_TANDEM if young else OLD_TANDEM
    return F.when((period >= 1) & (period <= len(mu)), bit_score(score, lam, F.element_at(F.array(*map(F.lit, mu)), period.cast("int")))).cast("long")


def bit_score(score: Column, lam: float, mu: Column) -> Column:
    """(score * lambda - ln mu) / ln 2."""
    return (score * lam - F.log(mu)) / F.log(F.lit(2.0))


def hmm_threshold(tau: Column, lam: Column, max_length: Column, z: float = 3000.0, e_value: float = 0.02) -> Column:
    """tau - ln(E / (Z / length)) / lambda."""
    return tau - F.log(e_value / (z / max_length)) / lam


def unit_complexity(unit: Column) -> Column:
    """Entropy of a repeat unit's letters, base 4, times its length."""
    n = F.length(unit)
    part = lambda b: F.when(F.length(F.translate(unit, b, "")) < n, (n - F.length(F.translate(unit, b, ""))) / n).otherwise(F.lit(None))
    ent = [F.coalesce(-part(b) * F.log(part(b)), F.lit(0.0)) for b in "ACGT"]
    return n * (ent[0] + ent[1] + ent[2] + ent[3]) / F.log(F.lit(4.0))


def simple_unit(name: Column) -> Column:
    """The unit of a simple repeat's name such as (CA)n; other names as they are."""
    return F.regexp_replace(name, r"^\((\w+).*", "$1")


def pre_mask_drop(name: Column, start: Column, end: Column, score: Column) -> Column:
    """Hits that go before mask levels count: parts of SVA that are LTR5 alone, and weak LAVA."""
    # Ranges of the consensus and the least score
    sva = ((start >= 855) & (end < 1270)) | ((start >= 1263) & (end < 1372))
    return (name.rlike("^SVA") & sva) | (name.rlike("^LAVA") & (score < 500))


def simple_repeat_kept(name: Column, div: Column, gaps: Column, score: Column) -> Column:
    """Whether a simple repeat is cut out: by divergence and gaps (percent) against its unit's complexity and its score; poly-A and satellites aren't."""
    unit = simple_unit(name)
    # 16, 3, 1.5, 200, 50 and 5
    most = 16 - 3 * (F.length(unit) - unit_complexity(unit))
    plain = ~name.rlike(r"\([GA]*\)") & (div + gaps / 1.5 <= most)
    return ~name.rlike(r"AAAAA|\(A\)n|Satellite") & (plain | (div + gaps < (score - 200) / 50) | (div + gaps <= 5))


def soundex(name: Column) -> Column:
    """The name's first character as it is, then three digits; equal neighbours once, and H and W are no neighbours but as the first letter."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    coded = F.translate(F.lower(letters), "bfpvcgjkqsxzdtlmnraeiouyhw", "11112222222233455600000099")
    rest = F.translate(F.substr(coded, F.lit(2)), "9", "")
    once = F.regexp_replace(F.concat(F.substr(coded, F.lit(1), F.lit(1)), rest), r"(\d)\1+", "$1")
    digits = F.regexp_replace(F.substr(once, F.lit(2)), "0", "")
    return F.concat(F.substr(name, F.lit(1), F.lit(1)), F.rpad(F.substr(digits, F.lit(1), F.lit(3)), 3, "0"))


def age_label(div: Column, low: Column, high: Column) -> Column:
    """X: younger than the split by 25 %; 0: older by 25 %; ?: between."""
    return F.when(div < low * 3 / 4, "X").when(div > high * 5 / 4, "0").otherwise("?")
