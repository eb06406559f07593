"""Text and number parsing as Column functions. Whitespace means what Unicode calls so."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import constants as K

_BLANK = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_match(pairs: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Value of the first condition that holds; a null condition does not."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), F.lit(None) if default is None else default)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body reads it: it becomes the variable of a function.

    An expression that is written out for each use grows with every step, past what generated code may hold.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- identifiers
def normalize_sku(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(strip(c), _BLANK, "-")), "[^A-Z0-9_.-]", "")


def is_valid_sku(c: Column, least: int = 1, most: int = 128) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Z0-9_.-]+\z") & F.length(c).between(least, most), F.lit(False))


def require_valid_sku(c: Column) -> Column:
    """Normalised, or null where nothing valid is left; scanner input goes the same way."""
    clean = normalize_sku(c)
    return F.when(is_valid_sku(clean), clean)


def sanitize_job_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), _BLANK, "_"), "[^a-z0-9_-]+", "")


def sanitize_collection_sku(c: Column) -> Column:
    return F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), "[^A-Z0-9_-]+", "")


def collection_job_id(job_type: Column, sku: Column, known: Column, at: Column) -> Column:
    """``GROUP``, the first item's known SKU or ``SINGLE``, then the time; null for another type."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    name = F.when(F.coalesce(known, F.lit(False)), F.nullif(sanitize_collection_sku(sku), F.lit("")))
    return F.when(job_type == "group", F.concat(F.lit("GROUP_"), stamp)).when(job_type == "single", F.concat(F.coalesce(name, F.lit("SINGLE")), F.lit("_"), stamp))


def resolve_job_id(given: Column, generated: Column) -> Column:
    """Generated collection ids as they are, others sanitised, blank ones replaced."""
    keep = F.when(given.rlike(r"\A(?:[A-Z0-9_-]+|SINGLE|GROUP)_\d{8}_\d{6}\z"), given)
    return F.coalesce(keep, F.nullif(sanitize_job_id(given), F.lit("")), generated)


def generated_job_id(job_type: Column, at: Column) -> Column:
    return F.concat(job_type, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 4))


def view_id(index: Column) -> Column:
    return F.format_string("view_%02d", index)


# --- arrangements
def normalize_arrangement(c: Column) -> Column:
    """``2 X 5`` as ``2x5``; null when it is none."""
    text = F.regexp_replace(F.lower(strip(c)), _BLANK, "")
    return F.when(text.rlike(r"\A[1-9][0-9]*x[1-9][0-9]*\z"), text)


def arrangement_dims(c: Column) -> tuple[Column, Column]:
    text = normalize_arrangement(c)
    return F.split(text, "x")[0].try_cast("int"), F.split(text, "x")[1].try_cast("int")


def view_mode(c: Column) -> Column:
    rows, cols = arrangement_dims(c)
    return F.when(rows == cols, "single_view").when(rows != cols, "two_view_rectangle")


def default_views(mode: Column) -> Column:
    return F.when(mode == "single_view", F.array(F.lit("view_01"))).when(mode == "two_view_rectangle", F.array(F.lit("view_01"), F.lit("view_02")))


def arrangement_summary(c: Column) -> Column:
    rows, cols = arrangement_dims(c)
    mode = view_mode(c)
    return F.struct(normalize_arrangement(c).alias("arrangement_type"), rows.alias("rows"), cols.alias("cols"), (rows * cols).alias("cell_count"), ((rows == 1) & (cols == 1)).alias("is_single"), (rows == cols).alias("is_square"), mode.alias("view_mode"), default_views(mode).alias("default_view_names"))


def view_role(name: Column, mode: Column) -> Column:
    low = F.lower(name)
    return first_match(
        [
            (low.contains("length"), F.lit("length_view")),
            (low.contains("width"), F.lit("width_view")),
            ((mode == "two_view_rectangle") & (low == "view_01"), F.lit("length_view")),
            ((mode == "two_view_rectangle") & (low == "view_02"), F.lit("width_view")),
            (mode == "single_view", F.lit("single_or_length")),
        ],
        F.lit("unknown"),
    )


# --- numbers
def positive_int(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n)


def nonnegative_int(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n >= 0, n)


def finite(c: Column) -> Column:
    """The value as a double, null when it is not a finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def positive(c: Column) -> Column:
    x = finite(c)
    return F.when(x > 0, x)


def safe_ratio(a: Column, b: Column) -> Column:
    """Null without a denominator or over 0."""
    return F.when(b != 0, F.try_divide(a, b))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """0.0 without a denominator or where it is 0 or less; for counts."""
    return F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(0.0)


def round_up(c: Column, increment: float = 1.0) -> Column:
    """Up to a multiple; null unless positive."""
    return F.when(c > 0, (F.ceil(c / increment) * increment).cast("double"))


def padded(c: Column, padding: float = 1.0) -> Column:
    return F.when(c > 0, c + padding)


def length_in_inches(value: Column, unit: Column) -> Column:
    u = F.lower(strip(unit))
    return F.when(u.isin("inch", "inches", "in", '"'), value).when(u == "cm", value / K.CM_PER_IN).when(u == "mm", value / K.MM_PER_IN)


def volume_in_quarts(value: Column, unit: Column) -> Column:
    u = F.lower(strip(unit))
    return F.when(u.isin("qt", "quart", "quarts"), value).when(u.isin("gal", "gallon", "gallons"), value * K.QT_PER_GALLON).when(u.isin("l", "liter", "liters", "litre", "litres"), value * K.QT_PER_LITRE)


# --- catalogue cells
def column_name(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), "_", " "), _BLANK, " ")
    text = strip(text)
    aliases = F.create_map(*[F.lit(x) for pair in K.COLUMN_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, text), F.regexp_replace(F.lower(text), " ", "_"))


def clean_text(c: Column) -> Column:
    text = blank_to_null(c.cast("string"))
    return F.when(F.lower(text) != "nan", text)


def clean_sku_cell(c: Column) -> Column:
    """Spreadsheet numbers lose their fraction zeros; other text stays."""
    text = clean_text(c)
    number = text.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.nullif(F.regexp_replace(strip(F.coalesce(plain, text)), r"\.0$", ""), F.lit(""))


def clean_price(c: Column) -> Column:
    """A number as text where the cell is one, else the text."""
    text = clean_text(c)
    return F.coalesce(F.regexp_replace(text, "[$,]", "").try_cast("double").cast("string"), text)


def token(c: Column, default: str = "unknown") -> Column:
    """Lower-case slug for use in a feature name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


# --- pot priors
def _prior(available: bool, shape: str, diameter: Column | None, width: Column | None, depth: Column | None, spec: Column, confidence: str, notes: list[str]) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(available).alias("available"),
        F.lit(shape).alias("shape"),
        (none if diameter is None else diameter).alias("diameter_in"),
        (none if width is None else width).alias("width_in"),
        (none if depth is None else depth).alias("depth_in"),
        none.alias("height_in"),
        spec.alias("raw_spec"),
        F.lit("sku_catalogue").alias("source"),
        F.lit(confidence).alias("confidence"),
        F.array(*[F.lit(n) for n in notes]).alias("notes"),
    )


def spec_prior(c: Column) -> Column:
    """Pot prior of a vendor's specification text: rectangle, then inches, then gallons, else unparsed."""
    nothing = F.lit(None).cast("string")

    def groups(text: Column) -> Column:
        number = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")
        return F.struct(text.rlike(K.INCH_RECT).alias("rect"), number(K.INCH_RECT, 1).alias("width"), number(K.INCH_RECT, 2).alias("depth"), text.rlike(K.INCH_ROUND).alias("round"), number(K.INCH_ROUND, 1).alias("diameter"), text.rlike(K.GALLON).alias("gallon"))

    def prior(raw: Column, g: Column) -> Column:
        return first_match(
            [
                (raw.isNull(), _prior(False, "unknown", None, None, None, nothing, "unknown", ["spec_missing"])),
                (g["rect"], _prior(True, "rectangular", None, g["width"], g["depth"], raw, "catalog", ["rectangular_dimensions_parsed_from_spec"])),
                (g["round"], _prior(True, "round", g["diameter"], g["diameter"], g["diameter"], raw, "catalog", ["diameter_parsed_from_spec", "width_depth_derived_from_diameter"])),
                (g["gallon"], _prior(False, "unknown", None, None, None, raw, "unknown", ["gallon_spec_not_mapped"])),
            ],
            _prior(False, "unknown", None, None, None, raw, "unknown", ["spec_unparsed"]),
        )

    return let(blank_to_null(c.cast("string")), lambda raw: let(let(F.regexp_replace(raw, _BLANK, " "), groups), lambda g: prior(raw, g)))


def model_confidence(confidence: Column) -> Column:
    c = F.coalesce(F.nullif(confidence, F.lit("")), F.lit("none"))
    return F.when(c == "catalog", "high").otherwise(c)


def nearest_container(volume: Column, containers: list[tuple[str, float, float]]) -> Column:
    """(name, diameter, delta) of the container nearest in volume, the earliest on a tie."""
    choices = F.array(*[F.struct(F.abs(F.lit(float(v)) - volume).alias("delta"), F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(float(d)).alias("diameter_in")) for i, (n, d, v) in enumerate(containers)])
    return F.when(volume.isNotNull(), F.array_min(choices))


def metadata_prior(fields: dict[str, Column], containers: list[tuple[str, float, float]], source: str = "sku_exact") -> Column:
    """Pot prior of an item's own fields, in order: numbers, lengths in text, volumes by the nearest container.

    ``fields`` maps the known keys to string columns; a numeric field is a plain number.
    """
    out = "struct<available:boolean,source:string,diameter_in:double,volume_qt:double,confidence:string,raw_value:string,raw_unit:string,note:string>"

    def found(available, src, diameter, volume, confidence, raw, unit, note) -> Column:
        d = F.lit(None) if diameter is None else diameter
        v = F.lit(None) if volume is None else volume
        return F.struct(F.lit(available).alias("available"), src.alias("source"), d.alias("diameter_in"), v.alias("volume_qt"), confidence.alias("confidence"), raw.alias("raw_value"), unit.alias("raw_unit"), note.alias("note")).cast(out)

    def parsed(text: Column) -> Column:
        volume = F.nullif(F.regexp_extract(text, K.VOLUME_TEXT, 1), F.lit("")).try_cast("double")
        unit = F.regexp_extract(text, K.VOLUME_TEXT, 2)
        return F.struct(
            F.when(text.rlike(r"\A[0-9.eE+-]+\z"), positive(text)).alias("number"),
            F.nullif(F.regexp_extract(text, K.LENGTH_TEXT, 1), F.lit("")).try_cast("double").alias("size"),
            F.regexp_extract(text, K.LENGTH_TEXT, 2).alias("size_unit"),
            volume_in_quarts(volume, unit).alias("volume"),
            unit.alias("volume_unit"),
        )

    def candidate(key: str, text: Column) -> Column:
        return let(text, lambda raw: hit(key, raw))

    def hit(key: str, raw: Column) -> Column:
        def choose(g: Column) -> Column:
            pairs = [
                (g["number"].isNotNull(), found(True, F.lit(source), g["number"], None, F.lit("high"), raw, F.lit("in"), F.lit(f"parsed_direct_numeric:{key}"))),
                (g["size"].isNotNull(), found(True, F.lit(source), length_in_inches(g["size"], g["size_unit"]), None, F.lit("high"), raw, g["size_unit"], F.lit(f"parsed_direct_length:{key}"))),
            ]
            if containers:
                near = let(nearest_container(g["volume"], containers), lambda best: found(True, F.lit("sku_container_lookup"), best["diameter_in"], g["volume"], F.when(best["delta"] <= 1.0, "medium").otherwise("low"), raw, g["volume_unit"], F.concat(F.lit("matched_container_lookup:"), best["name"])))
                pairs.append((g["volume"].isNotNull(), near))
            return first_match(pairs)

        return let(let(strip(raw), parsed), choose)

    nothing = F.lit(None).cast("string")
    raws = [(key, F.nullif(fields[key].cast("string"), F.lit(""))) for key in (*K.PRIOR_NUMERIC_KEYS, *K.PRIOR_TEXT_KEYS) if key in fields]
    missing = found(False, F.lit("missing"), None, None, F.lit("none"), nothing, nothing, F.lit("no_pot_prior_text_in_sku_metadata"))
    if not raws:
        return missing
    any_raw = F.coalesce(*[raw for _, raw in raws])
    hits = F.filter(F.array(*[candidate(key, raw) for key, raw in raws]), lambda x: x.isNotNull())
    unparsed = found(False, F.lit("unparseable"), None, None, F.lit("none"), any_raw, nothing, F.lit("unparseable_pot_prior"))
    return F.when(any_raw.isNull(), missing).otherwise(F.coalesce(F.get(hits, F.lit(0)), unparsed))


def segment_of_label(c: Column) -> Column:
    """Exact label first, then the first segment with a hint that the label contains."""
    low = F.lower(strip(c))
    exact = F.create_map(*[F.lit(x) for pair in K.SEGMENT_LABELS.items() for x in pair])
    hints = [(reduce(lambda a, b: a | b, [low.contains(h) for h in words]), F.lit(name)) for name, words in K.SEGMENT_HINTS.items()]
    return F.coalesce(F.try_element_at(exact, low), first_match(hints))


def canonical_key(*columns: Column) -> Column:
    """Hash of a nested setting whose floats count to nine digits."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def flatten(df: DataFrame, glue: str = "_") -> DataFrame:
    """Nested structs as flat columns ``a_b_c``."""

    def walk(schema, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(glue.join(here))

    return df.select(*walk(df.schema, ()))
