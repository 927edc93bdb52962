"""Column expressions on variant coordinates and id text.

An id reads ``chrom:pos:ref:['A', 'T']``: the alternative alleles appear in the
text form of a Python list, so the quotes and the comma-blank are part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def add_chr(chrom: Column) -> Column:
    return F.when(chrom.contains("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def strip_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def alts_text(alts: Column) -> Column:
    """List text of an allele array; the empty array gives ``[]``."""
    quoted = F.concat(F.lit("['"), F.array_join(alts, "', '"), F.lit("']"))
    return F.when(F.size(alts) == 0, F.lit("[]")).otherwise(quoted)


def variant_id(
    chrom: Column, pos: Column, ref: Column, alts: Column, chr_word: bool = False
) -> Column:
    """Id from parts with the alleles given as an array; null where a part is null."""
    name = add_chr(chrom) if chr_word else strip_chr(chrom)
    return _joined(name, pos.cast("string"), ref, alts_text(alts))


def _joined(*parts: Column) -> Column:
    """Parts with colons between them. A null part makes it null: a shorter id would match others."""
    colon = F.lit(":")
    return F.concat(*[x for part in parts for x in (colon, part)][1:])


def variant_id_from_alt(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Id from a comma-joined allele column; the chromosome is taken as it is, a null part gives null."""
    listed = F.concat(F.lit("['"), F.replace(alt, F.lit(","), F.lit("', '")), F.lit("']"))
    return _joined(chrom, pos.cast("string"), ref, listed)


def parse_variant_id(vid: Column) -> Column:
    """Struct (chrom, pos, ref, alts); alleles are read between quotes, so ``['GT']`` is one."""
    parts = F.split(vid, ":")
    return F.struct(
        parts[0].alias("chrom"),
        parts[1].cast("int").alias("pos"),
        parts[2].alias("ref"),
        F.regexp_extract_all(parts[3], F.lit("'([^']*)'"), F.lit(1)).alias("alts"),
    )


def interval_from_id(vid: Column, chr_word: bool = True) -> Column:
    """Struct (chr, start, end) covering ``[pos, pos + 1)``, position as written in the id."""
    v = parse_variant_id(vid)
    chrom = F.concat(F.lit("chr"), v["chrom"]) if chr_word else v["chrom"]
    return F.struct(chrom.alias("chr"), v["pos"].alias("start"), (v["pos"] + 1).alias("end"))


def interval_from_vcf(chrom: Column, pos: Column, ref: Column) -> Column:
    """Struct (chr, start, end), 0-based and half-open over the reference allele."""
    start = pos - 1
    return F.struct(
        chrom.alias("chr"), start.alias("start"), (start + F.length(ref)).alias("end")
    )


def stranded_interval(chrom: Column, pos: Column, strand: str = "*") -> Column:
    return F.struct(
        chrom.alias("chr"),
        pos.alias("start"),
        (pos + 1).alias("end"),
        F.lit(strand).alias("strand"),
    )


def flat_record(chrom: Column, pos: Column, name: Column, ref: Column, alts: Column) -> Column:
    """Struct record of a variant with its first allele; a missing name becomes a dot."""
    return F.struct(
        chrom.alias("chrom"),
        pos.alias("pos"),
        F.coalesce(name, F.lit(".")).alias("id"),
        ref.alias("ref"),
        F.get(alts, F.lit(0)).alias("alt"),
    )


def region_from_id(vid: Column) -> Column:
    v = parse_variant_id(vid)
    return F.struct(
        v["chrom"].alias("chrom"),
        v["pos"].alias("pos"),
        v["ref"].alias("ref"),
        F.get(v["alts"], F.lit(0)).alias("alt"),
    )


def vcf_line_from_id(vid: Column, row_id: Column) -> Column:
    """Five-column VCF line named ``v<row_id + 1>`` with the first allele."""
    r = region_from_id(vid)
    return F.concat_ws(
        "\t",
        r["chrom"],
        r["pos"].cast("string"),
        F.concat(F.lit("v"), (row_id + 1).cast("string")),
        r["ref"],
        r["alt"],
    )


def info_entry(info: Column, key: str) -> Column:
    """Value of ``key=`` inside a semicolon-joined INFO text, null where absent."""
    return F.nullif(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def first_annotation_scores(csq: Column) -> Column:
    """Struct (scaled_score, raw_score) from the first entry of an annotation text.

    Entries are comma-joined and their fields bar-joined; an empty field is null.
    """
    fields = F.split(F.split(csq, ",")[0], "\\|")

    def number(i: int) -> Column:
        return F.nullif(F.get(fields, F.lit(i)), F.lit("")).cast("double")

    return F.struct(number(0).alias("scaled_score"), number(1).alias("raw_score"))


def gtf_attributes(text: Column) -> Column:
    """Array of (key, value) structs; a key such as ``tag`` may occur several times."""
    keys = F.regexp_extract_all(text, F.lit('(\\w+) "[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit('\\w+ "([^"]*)"'), F.lit(1))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def gtf_attribute(text: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(text, f'\\b{key} "([^"]*)"', 1), F.lit(""))
