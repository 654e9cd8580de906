"""Column lineage from the text of a single-block ``SELECT``.

Everything here is a column expression over one event's SQL text: no shuffle, no Python.
One quote-aware scan cuts comments, literals and quoted names out and leaves numbered marks; a second one folds
every parenthesised group of the outermost level into a mark, at any depth. Clauses, joins and commas are looked for in
that outline only, so nothing inside a literal, a name or a call is taken for one.

Supported: one ``SELECT ... FROM ... [JOIN ...]`` block over named tables. Nested queries, set operations, common table
expressions, table functions and all that is not understood give no rows and are reported by :func:`is_unsupported`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.schemas import SPEC

# Dialects whose text is read; those where a backslash escapes in a literal; those where double quotes
# hold a literal and not a name; those with # comments.
DIALECTS = ["postgres", "postgresql", "mysql", "sqlite", "bigquery", "snowflake", "hive", "clickhouse"]
_BACKSLASH = ["mysql", "bigquery", "hive", "clickhouse", "snowflake"]
_QUOTE_IS_LITERAL = ["mysql", "bigquery", "hive"]
_HASH_COMMENT = ["mysql", "bigquery"]

DATASET_ATTRIBUTE = "__dataset__"

# Aggregate functions of the dialects. ClickHouse adds endings to any of them.
_AGGREGATES = (
    "sum|sum0|sumkahan|total|count|avg|avgweighted|min|max|median|mode|product|"
    "std|stddev|stddev_pop|stddev_samp|stddevpop|stddevsamp|variance|var_pop|var_samp|varpop|varsamp|"
    "corr|covar_pop|covar_samp|covarpop|covarsamp|regr_[a-z0-9]+|skewness|kurtosis|skew[a-z]+|kurt[a-z]+|entropy|"
    "array_agg|array_concat_agg|array_union_agg|array_unique_agg|string_agg|group_concat|listagg|collect_list|collect_set|"
    "any|anylast|anyheavy|any_value|some|every|first|last|first_value|last_value|nth_value|lag|lead|"
    "max_by|min_by|argmin|argmax|arg_min|arg_max|count_if|countif|count_distinct|"
    "approx_distinct|approx_count_distinct|approx_quantile|approx_quantiles|approx_percentile|approx_top_k|approx_top_count|"
    "approx_top_sum|hll|uniq|uniqexact|uniqcombined|uniqcombined64|uniqhll12|uniqthetasketch|topk|topkweighted|"
    "quantile|quantiles|quantile[a-z0-9]+|quantiles[a-z0-9]+|percentile|percentile_cont|percentile_disc|percentile_approx|"
    "bool_and|bool_or|booland_agg|boolor_agg|logical_and|logical_or|bit_and|bit_or|bit_xor|bit_and_agg|bit_or_agg|bit_xor_agg|"
    "groupbitand|groupbitor|groupbitxor|grouparray|groupuniqarray|grouparray[a-z0-9]+|sum_if|avg_if|min_if|max_if|"
    "json_agg|jsonb_agg|json_object_agg|jsonb_object_agg|json_arrayagg|json_objectagg|json_group_array|json_group_object|"
    "object_agg|map_agg|summap|minmap|maxmap|sumwithoverflow|grouping"
)
_ENDINGS = "(?:if|array|map|distinct|ordefault|ornull|foreach|resample|state|simplestate|merge|mergestate)*"
_NOT_COLUMNS = [
    "select", "distinct", "all", "case", "when", "then", "else", "end", "and", "or", "xor", "not", "null", "is", "in",
    "like", "ilike", "rlike", "regexp", "similar", "to", "escape", "between", "true", "false", "unknown", "interval", "as",
    "from", "for", "div", "mod", "collate", "current_date", "current_time", "current_timestamp", "localtime",
    "localtimestamp", "current_user", "session_user", "asc", "desc", "nulls", "over", "partition", "order", "by", "rows",
    "range", "groups", "unbounded", "preceding", "following", "current", "row", "ties", "others", "exclude", "within",
    "group", "filter", "where", "separator", "both", "leading", "trailing", "at", "zone",
]

_WORD = r"[A-Za-z_][A-Za-z0-9_$]*"
_QUALIFIED = rf"(?<![A-Za-z0-9_$.])(?:{_WORD}\s?\.\s?)+(?:{_WORD}|\*)(?![A-Za-z0-9_$]|\s*\()"
_BARE = rf"(?<![A-Za-z0-9_$.'])({_WORD})(?![A-Za-z0-9_$.]|\s*\()"
_TAIL = r"(?i)\s(?:where|group by|having|order by|limit|offset|window|qualify|fetch)\b.*$"
_JOIN = r"(?i)\s*(?:\s(?:natural|left|right|full|inner|outer|cross)\b\s*)*\sjoin\s"
_NAME = rf"(?:{_WORD}\s?\.\s?)*{_WORD}"
_ITEM = rf"(?i)^({_NAME})(?:\s+(?:as\s+)?(?!on\b|using\b|natural\b|left\b|right\b|full\b|inner\b|outer\b|cross\b|lateral\b|final\b|sample\b|tablesample\b)({_WORD}))?\s*(?:\bon\b\s*(.+)|using\s*\([^)]*\))?$"


def is_readable_dialect(dialect: Column) -> Column:
    return F.coalesce(F.lower(dialect).isin(DIALECTS), F.lit(False))


def _pattern(backslash: bool, hash_comment: bool) -> str:
    inner = (lambda q: rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}") if backslash else (lambda q: f"{q}[^{q}]*{q}")
    comment = r"--[^\n]*|/\*.*?\*/" + (r"|#[^\n]*" if hash_comment else "")
    return f"(?s){comment}|{inner(chr(39))}|{inner(chr(34))}|`[^`]*`|[^'\"`#/-]+|."


@dataclass(frozen=True)
class Text:
    """Columns made from one text: its tokens, the text with marks, its outline, and the groups folded there."""

    tokens: Column
    code: Column
    outline: Column
    groups: Column
    quote_is_literal: Column

    def unfolded(self, text: Column) -> Column:
        """Groups put back."""
        return F.aggregate(self.groups, text, lambda acc, g: F.replace(acc, g["mark"], g["text"]))

    def _kept(self) -> Column:
        quoted = F.transform(self.tokens, lambda t, i: F.struct(t.alias("text"), i.alias("i")))
        return F.filter(quoted, lambda q: q["text"].rlike("^['\"`]"))

    def original(self, text: Column) -> Column:
        """Groups, names and literals put back as they were written."""
        names = F.aggregate(
            self._kept(), self.unfolded(text), lambda acc, q: F.replace(acc, _name_mark(q["i"]), q["text"])
        )
        return F.aggregate(self._kept(), names, lambda acc, q: F.replace(acc, _literal_mark(q["i"]), q["text"]))

    def name(self, word: Column) -> Column:
        """What a word or the mark of a quoted name or literal stands for."""
        number = F.nullif(F.regexp_extract(word, r"^(?:_\$q|'\x02)(\d+)(?:\$|\x02')$", 1), F.lit(""))
        token = F.get(self.tokens, number.cast("int"))
        return F.when(number.isNull(), word).otherwise(_inside(token))


def _inside(token: Column) -> Column:
    return F.substring(token, F.lit(2), F.length(token) - 2)


def _name_mark(i: Column) -> Column:
    return F.concat(F.lit("_$q"), i, F.lit("$"))


def _literal_mark(i: Column) -> Column:
    return F.concat(F.lit("'\x02"), i, F.lit("\x02'"))


def _tokens(sql: Column, dialect: Column) -> Column:
    named = F.coalesce(F.lower(dialect), F.lit(""))
    patterns = F.when(named.isin(_HASH_COMMENT), _pattern(True, True)).when(named.isin(_BACKSLASH), _pattern(True, False))
    return F.regexp_extract_all(sql, patterns.otherwise(_pattern(False, False)), F.lit(0))


def _code(tokens: Column, quote_is_literal: Column) -> Column:
    def mark(t: Column, i: Column) -> Column:
        closed = F.length(t) > 1
        return (
            F.when(t.startswith("--") | t.startswith("/*") | (t.startswith("#") & closed), F.lit(" "))
            .when(closed & (t.startswith("'") | (t.startswith('"') & quote_is_literal)), _literal_mark(i))
            .when(closed & t.rlike('^["`]'), _name_mark(i))
            .otherwise(t)
        )

    text = F.array_join(F.transform(tokens, mark), "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[;\s]+$", ""))


def _folded(code: Column) -> Column:
    """``struct(depth, low, open, outline, groups)`` after the last sign."""
    none = F.array().cast("array<struct<mark:string,text:string>>")

    def add(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        closes = (t == ")") & (depth == 0)
        mark = F.concat(F.lit("\x01"), F.size(acc["groups"]), F.lit("\x01"))
        return F.struct(
            depth.alias("depth"),
            F.least(acc["low"], depth).alias("low"),
            F.when(closes, "").when((acc["depth"] > 0) & (depth > 0), F.concat(acc["open"], t)).otherwise(acc["open"]).alias("open"),
            F.when(closes, F.concat(acc["outline"], F.lit("("), mark, F.lit(")")))
            .when((acc["depth"] == 0) & (t != "("), F.concat(acc["outline"], t))
            .otherwise(acc["outline"])
            .alias("outline"),
            F.when(closes, F.concat(acc["groups"], F.array(F.struct(mark.alias("mark"), acc["open"].alias("text")))))
            .otherwise(acc["groups"])
            .alias("groups"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit("").alias("open"), F.lit("").alias("outline"), none.alias("groups")
    )
    return F.aggregate(F.regexp_extract_all(code, F.lit(r"[()]|[^()]+"), F.lit(0)), start, add)


def _scan(df: DataFrame, sql: Column, dialect: Column) -> tuple[DataFrame, Text]:
    """``df`` with the columns of a :class:`Text`, each made once per row."""
    literal = F.coalesce(F.lower(dialect).isin(_QUOTE_IS_LITERAL), F.lit(False))
    df = df.withColumn("_tokens", _tokens(sql, dialect)).withColumn("_code", _code(F.col("_tokens"), literal))
    df = df.withColumn("_folded", _folded(F.col("_code")))
    df = df.withColumn("_outside", _outside(F.col("_tokens"), F.col("_code"), F.col("_folded")))
    return df, Text(F.col("_tokens"), F.col("_code"), F.col("_folded.outline"), F.col("_folded.groups"), literal)


def is_unsupported(sql: Column, dialect: Column | None = None) -> Column:
    """True for text outside the supported subset."""
    dialect = F.lit(None).cast("string") if dialect is None else dialect
    tokens = _tokens(sql, dialect)
    code = _code(tokens, F.coalesce(F.lower(dialect).isin(_QUOTE_IS_LITERAL), F.lit(False)))
    return _outside(tokens, code, _folded(code))


def _outside(tokens: Column, code: Column, folded: Column) -> Column:
    outline = folded["outline"]
    torn = F.exists(tokens, lambda t: t.isin("'", '"', "`") | t.rlike("[\x01\x02]|_\\$q"))
    torn = torn | (folded["depth"] != 0) | (folded["low"] < 0)
    nested = code.rlike(r"(?i)^.+\b(?:select|union|intersect|except|minus|with|lateral|pivot|unpivot|prewhere|settings)\b")
    # Signs and forms whose parts are not read: arrays, lambdas, parameters, named windows, places of a select list.
    foreign = code.rlike(r"(?i)[\[\]{}@?\\]|->|=>|:=|(?<!:):(?!:)|\bover\s+(?!\()|^select (?:top|distinct on|as)\b")
    items = _tables(outline)
    strange = F.exists(items, lambda x: ~x.rlike(_ITEM))
    one_block = outline.rlike(r"(?i)^select\s.+\sfrom\s.+$")
    return torn | ~one_block | nested | foreign | strange


def _projection_text(outline: Column) -> Column:
    return F.regexp_extract(outline, r"(?i)^select (?:distinct |all )?(.*?) from ", 1)


def _from_text(outline: Column) -> Column:
    rest = F.regexp_extract(outline, r"(?i)^select .*? from (.*)$", 1)
    return F.trim(F.regexp_replace(rest, _TAIL, ""))


def _tables(outline: Column) -> Column:
    """The items of FROM: each a table with its alias and condition."""
    return F.transform(F.split(_from_text(outline), _JOIN + r"|\s*,\s*"), lambda x: F.trim(x))


def _words(qualified: Column, text: Text) -> Column:
    """The parts of a dotted name, unquoted."""
    return F.transform(F.split(qualified, r"\s?\.\s?"), lambda w: text.name(w))


def table_aliases(text: Text, inputs: Column) -> Column:
    """``array<struct<key, tbl>>``: each alias and bare table name of FROM/JOIN with its dataset.

    A table in the text is the first input whose name equals it or ends with it after a dot;
    otherwise the text itself.
    """

    def entry(item: Column) -> Column:
        name = F.array_join(_words(F.regexp_extract(item, _ITEM, 1), text), ".")
        alias = F.nullif(F.regexp_extract(item, _ITEM, 2), F.lit(""))
        short = F.element_at(F.split(name, r"\."), -1)
        matched = F.get(F.filter(inputs, lambda n: (n == name) | F.endswith(n, F.concat(F.lit("."), name))), F.lit(0))
        tbl = F.coalesce(matched, name)
        return F.array(
            F.struct(F.coalesce(text.name(alias), short).alias("key"), tbl.alias("tbl")),
            F.struct(short.alias("key"), tbl.alias("tbl")),
        )

    return F.flatten(F.transform(_tables(text.outline), entry))


def _resolve(aliases: Column, key: Column) -> Column:
    """The latest entry for an alias wins."""
    return F.get(F.reverse(F.filter(aliases, lambda a: a["key"] == key)), F.lit(0))["tbl"]


def _plain(code: Column) -> Column:
    """An expression without the words of its syntax that look like columns."""
    for pattern, by in (
        (r"(?i)\bextract\s*\(\s*\w+\s+from\b", "extract("),
        (r"(?i)\b(?:date|time|timestamp|datetime|interval)\s*'[^']*'(?:\s+(?:year|quarter|month|week|day|hour|minute|second)s?\b)?", "''"),
        (r"(?i)\binterval\s+\d+\s+\w+", "''"),
        (r"(?i)\bat time zone\b", " "),
        (rf"::\s*{_WORD}", ""),
        (rf"(?i)\sas\s+{_WORD}", ""),
    ):
        code = F.regexp_replace(code, pattern, by)
    return code


def _references(item: Column, text: Text, aliases: Column, only_input: Column | None) -> Column:
    """Distinct ``struct<tbl, attr>`` of the columns in an expression, in text order."""
    code = text.unfolded(item)

    def qualified(ref: Column) -> Column:
        words = _words(ref, text)
        tbl = _resolve(aliases, F.element_at(words, -2))
        if only_input is not None:
            tbl = F.coalesce(tbl, only_input)
        return F.struct(tbl.alias("tbl"), F.element_at(words, -1).alias("attr"))

    refs = F.transform(F.regexp_extract_all(code, F.lit(f"({_QUALIFIED})")), qualified)
    if only_input is not None:
        names = F.filter(F.regexp_extract_all(_plain(code), F.lit(_BARE)), lambda n: ~F.lower(n).isin(_NOT_COLUMNS))
        bare = F.transform(names, lambda n: F.struct(only_input.alias("tbl"), text.name(n).alias("attr")))
        refs = F.concat(refs, bare)
    return F.filter(refs, lambda r: r["tbl"].isNotNull())


def _spec(output_table, output_attribute, ref, lineage_type, subtype, scope, expression) -> Column:
    return F.struct(
        F.lit(0).alias("spec_no"),
        output_table.alias("output_table"),
        output_attribute.alias("output_attribute"),
        ref["tbl"].alias("input_table"),
        ref["attr"].alias("input_attribute"),
        F.lit(lineage_type).alias("lineage_type"),
        subtype.alias("lineage_subtype"),
        F.lit(None).cast("string").alias("lineage_description"),
        F.lit(None).cast("boolean").alias("lineage_masking"),
        F.lit(scope).alias("lineage_scope"),
        F.lit("sql_parsing").alias("source"),
        expression.alias("expression"),
    )


def projection_specs(text: Text, aliases: Column, inputs: Column, output_table: Column) -> Column:
    """One array of specification rows per projection that reads at least one known column."""
    only_input = F.when(F.size(inputs) == 1, inputs[0])
    bare = rf"^(?:{_WORD}\s?\.\s?)*({_WORD}|\*)$"
    aliased = rf"(?i)^(.+?)(?:\s+as\s+({_WORD}|'\x02\d+\x02')|(?<=[\w$)'])\s+({_WORD}))$"
    cast = rf"(?i)^(?:(?:try_|safe_)?cast\s*\(\s*(?:{_WORD}\s?\.\s?)*({_WORD})\s+as\s.*\)|(?:{_WORD}\s?\.\s?)*({_WORD})\s*::.+)$"

    def either(item: Column, pattern: str, first: int) -> Column:
        return F.concat(F.regexp_extract(item, pattern, first), F.regexp_extract(item, pattern, first + 1))

    def per_projection(item: Column) -> Column:
        is_bare = item.rlike(bare) & (item != "*")
        alias = either(item, aliased, 2)
        has_alias = item.rlike(aliased) & ~F.lower(alias).isin(_NOT_COLUMNS)
        plain = F.nullif(either(text.unfolded(item), cast, 1), F.lit(""))  # a cast column keeps its name
        name = F.when(is_bare, F.regexp_extract(item, bare, 1)).when(has_alias, alias).otherwise(plain)
        body = F.when(has_alias & ~is_bare, F.regexp_extract(item, aliased, 1)).otherwise(item)
        subtype = (
            F.when(text.unfolded(item).rlike(rf"(?i)(?<![\w$.])(?:{_AGGREGATES}){_ENDINGS}\s*\("), F.lit("AGGREGATION"))
            .when(is_bare, F.lit("IDENTITY"))
            .otherwise(F.lit("DERIVED"))
        )
        refs = F.array_distinct(_references(body, text, aliases, only_input))
        written = text.original(item)
        rows = F.transform(refs, lambda r: _spec(output_table, text.name(name), r, "SQL", subtype, "FIELD", written))
        return F.when(name.isNotNull(), rows).otherwise(F.array().cast(f"array<{SPEC}>"))

    items = F.transform(F.split(_projection_text(text.outline), ","), lambda x: F.trim(x))
    return F.filter(F.transform(items, per_projection), lambda rows: F.size(rows) > 0)


def join_specs(text: Text, aliases: Column, output_table: Column) -> Column:
    """One single-row array per column inside each JOIN, aimed at the whole output dataset."""
    joins = F.split(_from_text(text.outline), r"(?i)\sjoin\s")
    kind_word = r"(?i)(?:\s(?:natural|left|right|full|inner|outer|cross))+$"

    def per_join(item: Column) -> Column:
        whole = F.regexp_replace(item, kind_word, "")
        refs = _references(F.regexp_extract(whole, r"(?i)\son\b\s*(.*)$", 1), text, aliases, None)
        expression = F.concat(F.lit("JOIN "), text.original(whole))
        return F.transform(
            refs,
            lambda r: F.array(
                _spec(output_table, F.lit(DATASET_ATTRIBUTE), r, "INDIRECT", F.lit("JOIN"), "DATASET", expression)
            ),
        )

    return F.flatten(F.transform(F.slice(joins, 2, F.size(joins)), per_join))


def with_sql_specs(
    df: DataFrame, name: str, sql: Column, dialect: Column, inputs: Column, output_table: Column
) -> DataFrame:
    """Add column ``name``: the specification rows of ``sql``, or null where ``sql`` is null.

    The scanned text and the alias table are columns of their own, so each is computed
    once per row and not once per reference.
    """
    scanned, text = _scan(df.withColumn("_sql", sql), F.col("_sql"), dialect)
    aliases = F.col("_aliases")
    groups = F.concat(projection_specs(text, aliases, inputs, output_table), join_specs(text, aliases, output_table))
    numbered = F.flatten(
        F.transform(F.col("_groups"), lambda rows, i: F.transform(rows, lambda r: r.withField("spec_no", i)))
    )
    none = F.array().cast(f"array<{SPEC}>")
    readable = F.col("_sql").isNotNull() & ~F.col("_outside")
    return (
        scanned.withColumn("_aliases", F.when(readable, table_aliases(text, inputs)))
        .withColumn("_groups", F.when(readable, groups))
        .withColumn(name, F.when(F.col("_sql").isNotNull(), F.coalesce(numbered, none)))
        .drop("_sql", "_tokens", "_code", "_folded", "_outside", "_aliases", "_groups")
    )
