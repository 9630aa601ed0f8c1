"""Packed strings: comma lists, "name:result" pair lists and "group{pairs} | group{NA}" maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.functions.text import SPACES, strip

# The drugs whose results are shown.
DRUGS_SHOWN = [
    "Ampicillin", "Meropenem", "Ampicillin Sulbactam", "Sulfamethoxazole trimethoprim",
    "Cefotaxime", "Levofloxacin", "Piperacillin Tazobactam", "Ceftazidime", "Ertapenem",
    "Ciprofloxacin", "Penicillin G", "Tetracycline", "Vancomycin", "Oxacillin",
    "Ceftriaxone", "Amoxicillin clavulanate",
]

PAIR_TYPE = "array<struct<name:string,result:string>>"
#: A character other than the printable ones of ASCII, to which no white space but the blank belongs.
NOT_PLAIN = "[^ -~]"
BLOCK = r"^\s*([^{}]+)\{(.*)\}\s*$"
#: The same for trimmed parts in batches; there a dot would match more line ends.
BATCH_BLOCK = r"^(?P<grp>[^{}]+)\{(?P<body>[^\n\r\x{85}\x{2028}\x{2029}]*)\}$"


def _blank_trim(c: Column) -> Column:
    return F.trim(c)


def _trimmed(c: Column, parse) -> Column:
    """``parse(c, trim)``. In texts of printable ASCII only the blank can be trimmed, which is some ten times cheaper. Give it a plain column."""
    return F.when(c.rlike(NOT_PLAIN), parse(c, strip)).otherwise(parse(c, _blank_trim))


def _parts(c: Column, sep: str, trim=strip) -> Column:
    """Trimmed non-empty parts; an empty array for null."""
    return F.array_remove(F.transform(F.split(F.coalesce(c, F.lit("")), sep, -1), trim), "")


def comma_list(c: Column) -> Column:
    """Distinct trimmed items in first-seen order."""
    return F.array_distinct(_trimmed(c, lambda c, trim: _parts(c, ",", trim)))


def pairs(items: Column, trim=strip) -> Column:
    """"a:b" items as structs, split at the first colon; items without a colon are dropped."""
    with_colon = F.filter(items, lambda x: x.contains(":"))
    return F.transform(with_colon, lambda x: F.struct(
        trim(F.substring_index(x, ":", 1)).alias("name"),
        trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("result")))


def flat_pairs(c: Column) -> Column:
    """"a:b; c:d" as an array of structs."""
    return _trimmed(c, lambda c, trim: pairs(_parts(c, ";", trim), trim))


def shown(pair_array: Column, names: list[str] | None = None) -> Column:
    """Pairs whose name is listed (exact case)."""
    return F.filter(pair_array, lambda p: p["name"].isin(DRUGS_SHOWN if names is None else names))


def named_blocks(c: Column) -> Column:
    """array<struct<grp, items>> of the well-formed blocks, repeated groups included."""

    def parse(c: Column, trim) -> Column:
        if trim is strip:
            fitting = F.filter(_parts(c, r"\|"), lambda b: b.rlike(BLOCK))
            blocks = F.transform(fitting, lambda b: F.struct(
                strip(F.regexp_extract(b, BLOCK, 1)).alias("grp"),
                strip(F.regexp_extract(b, BLOCK, 2)).alias("body")))
        else:  # the same for trimmed parts without a line end
            fitting = F.filter(_parts(c, r"\|", trim), lambda b: b.endswith("}") & (F.instr(b, "{") > 1)
                               & ~F.substring_index(b, "{", 1).contains("}"))
            blocks = F.transform(fitting, lambda b: F.struct(
                trim(F.substring_index(b, "{", 1)).alias("grp"),
                trim(F.substring(b, F.instr(b, "{") + 1, F.length(b) - F.instr(b, "{") - 1)).alias("body")))
        return F.transform(blocks, lambda b: F.struct(
            b["grp"].alias("grp"),
            F.when(F.upper(b["body"]) == "NA", F.array().cast("array<string>"))
            .otherwise(_parts(b["body"], ";", trim)).alias("items")))

    return _trimmed(c, parse)


def last_of_group(named: Column) -> Column:
    """The last block of each group. Give it a plain column: it is read once per block."""
    return F.filter(named, lambda b, i: ~F.exists(
        F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda later: later["grp"] == b["grp"]))


def with_blocks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the parsed blocks of a packed column; staged, so that the text is parsed once."""
    return (df.withColumn(out, named_blocks(F.col(column)))
            .withColumn(out, F.when(F.size(out) < 2, F.col(out)).otherwise(last_of_group(F.col(out)))))


def blocks_map(blocks: Column) -> Column:
    """map<group, array<item>> from distinct blocks."""
    return F.map_from_entries(blocks)


def block_pairs(blocks: Column) -> Column:
    """All pairs of all blocks, sorted and distinct."""
    return in_order(F.flatten(F.transform(blocks, lambda b: shown(pairs(b["items"])))))


def in_order(pair_array: Column) -> Column:
    """Distinct pairs, sorted. Entries are never null, so the order of nulls does not matter."""
    return F.sort_array(F.array_distinct(pair_array))


def drug_lines(items: Column) -> Column:
    """The lines of a drug list as text, null if there is none. Give it a plain column."""
    lines = F.transform(items, lambda d, i: F.concat(F.lit("  o Antibiotic_"), (i + 1).cast("string"), F.lit(": "), d))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n"))


def pair_lines(pair_array: Column) -> Column:
    """The lines of shown pairs as text, null if there is none. Give it a plain column."""
    lines = F.transform(pair_array, lambda p: F.concat(F.lit("  o "), p["name"], F.lit(": "), p["result"]))
    return F.when(F.size(pair_array) > 0, F.array_join(lines, "\n"))


def first_non_empty(lists: list[Column]) -> Column:
    """The first list that is there; lists without an item must be null. An empty array if none is."""
    return F.coalesce(*lists, F.array().cast("array<string>"))


def _batch_parts(c: pa.Array, sep: str) -> tuple[np.ndarray, pa.Array]:
    """:func:`_parts` of a batch as (row, part), in the order of the rows."""
    lists = pc.split_pattern(pc.fill_null(c, ""), sep)
    parts = pc.utf8_trim(lists.flatten(), characters=SPACES)
    kept = pc.not_equal(parts, "")
    return np.asarray(pc.list_parent_indices(lists))[np.asarray(kept)], parts.filter(kept)


def _codes(values: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the texts, equal for equal texts."""
    coded = values.dictionary_encode()
    place = np.empty(len(coded.dictionary), dtype=np.int64)
    place[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(place))
    return place[np.asarray(coded.indices)]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places of the first row of each combination of keys, in their order."""
    order = np.lexsort(keys[::-1])  # stable: of equal rows the first comes first
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return np.sort(order[new])


def _batch_pairs(row: np.ndarray, items: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, name, result) of the items with a colon whose name is among the drugs shown."""
    colon = pc.match_substring(items, ":")
    row, sides = row[np.asarray(colon)], pc.split_pattern(items.filter(colon), ":", max_splits=1).flatten()
    at = np.arange(len(row)) * 2
    name, result = (pc.utf8_trim(sides.take(pa.array(i)), characters=SPACES) for i in (at, at + 1))
    listed = pc.is_in(name, pa.array(DRUGS_SHOWN))
    return row[np.asarray(listed)], name.filter(listed), result.filter(listed)


def _in_order(row: np.ndarray, name: pa.Array, result: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Distinct pairs of each row, by name and result."""
    names, results = _codes(name), _codes(result)
    order = np.lexsort((results, names, row))
    order = order[_firsts(row[order], names[order], results[order])]
    return row[order], name.take(pa.array(order)), result.take(pa.array(order))


def _offsets(row: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32))


def batch_lists(drugs: pa.Array, by_group: pa.Array, flat: pa.Array, fallback_on_pairs: bool, as_lines: bool) -> pa.Array:
    """For a batch of rows what :func:`comma_list` gives of ``drugs``, and of ``by_group`` :func:`block_pairs` of the last blocks of its
    groups, else the shown :func:`flat_pairs` of ``flat``.

    "Else" is where ``by_group`` has no block, or with ``fallback_on_pairs`` no pair; then the flat pairs are sorted and distinct too.
    With ``as_lines`` a list comes as the text of its lines, null if empty.
    """
    drugs, by_group, flat = (c.cast(pa.string()) for c in (drugs, by_group, flat))
    n = len(drugs)
    drug_row, drug = _batch_parts(drugs, ",")
    first = _firsts(drug_row, _codes(drug))
    drug_row, drug = drug_row[first], drug.take(pa.array(first))

    block_row, parts = _batch_parts(by_group, "|")
    found = pc.extract_regex(parts, BATCH_BLOCK)
    fits = pc.is_valid(found)
    block_row, found = block_row[np.asarray(fits)], found.filter(fits)
    group, body = (pc.utf8_trim(pc.struct_field(found, f), characters=SPACES) for f in ("grp", "body"))
    last = np.sort(len(group) - 1 - _firsts(block_row[::-1], _codes(group)[::-1]))
    body = body.take(pa.array(last))
    body = pc.if_else(pc.equal(pc.ascii_upper(body), "NA"), "", body)
    at, items = _batch_parts(body, ";")
    row, name, result = _in_order(*_batch_pairs(block_row[last][at], items))

    rest = np.bincount(row if fallback_on_pairs else block_row, minlength=n) == 0
    more = _batch_pairs(*_batch_parts(pc.if_else(pa.array(rest), flat, ""), ";"))
    if fallback_on_pairs:
        more = _in_order(*more)
    order = np.argsort(np.r_[row, more[0]], kind="stable")
    row = np.r_[row, more[0]][order]
    name, result = (pa.concat_arrays(both).take(pa.array(order)) for both in ((name, more[1]), (result, more[2])))
    drug_at, pair_at = _offsets(drug_row, n), _offsets(row, n)
    if not as_lines:
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(drug_at, drug), pa.ListArray.from_arrays(
            pair_at, pa.StructArray.from_arrays([name, result], ["name", "result"]))], ["drugs", "pairs"])
    number = pa.array(np.arange(len(drug_row)) - np.asarray(drug_at)[drug_row] + 1).cast(pa.string())
    lines = (pa.ListArray.from_arrays(drug_at, pc.binary_join_element_wise("  o Antibiotic_", number, ": ", drug, "")),
             pa.ListArray.from_arrays(pair_at, pc.binary_join_element_wise("  o ", name, ": ", result, "")))
    texts = [pc.if_else(pc.equal(pc.list_value_length(x), 0), pa.scalar(None, pa.string()), pc.binary_join(x, "\n")) for x in lines]
    return pa.StructArray.from_arrays(texts, ["drugs", "pairs"])


def episode_lists(drugs: Column, by_group: Column, flat: Column, fallback_on_pairs: bool, as_lines: bool = False) -> Column:
    """struct<drugs, pairs> by :func:`batch_lists`. Lists of lists cost interpreted calls per element as expressions."""
    kind = "struct<drugs:string,pairs:string>" if as_lines else f"struct<drugs:array<string>,pairs:{PAIR_TYPE}>"

    @F.arrow_udf(kind)
    def lists(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return batch_lists(a, b, c, fallback_on_pairs, as_lines)

    return lists(drugs, by_group, flat)
