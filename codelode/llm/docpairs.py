"""Functions paired with their documentation (problem 2).

Texts are lexed by one regular expression into tokens, exploded into rows, and all structure comes from windows over the
rows of one text: cumulative depth finds nesting, gaps-and-islands over ``;``, ``{`` and ``}`` find statements, a brace
and its partner are neighbours on their level, and lags attach comments to the statement after them. Everything runs in
the JVM; a text's rows are bounded by the text.

``functions`` finds the functions of whole texts with the comments attached to them. Two operators make pairs of them:

- ``symbol_pairs``: those that are symbols of the index, by file, line and name;
- ``source_pairs``: all of them.

Both keep only documentation worth the name (``described``): the docstring's lines become rows, islands of lines form
remarks, each remark is classified, and at least ``least`` words of explanation must be left that are not words of the
name. Placeholders, reminders, notices of generators, pointers elsewhere, switches for tools, tags and code don't count.

Defined cases: null or blank signatures and docstrings give no pair; repeated rows give one pair; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.workspace import settled

# Words that open or make up remarks without explanation, in the usual spellings.
REMINDER = r"^(?:todo|fixme|xxx|tbd|hack|wip)\b"
PLACEHOLDER = (
    r"^(?:n/?a|none|null|todo|tbd|description|documentation|helper|internal|deprecated|getter|setter|constructor|destructor|initiali[sz]er|override)\W*$"
    r"|^add (?:a |the )?(?:description|documentation|docs?|comments?|summary)\b|^(?:missing|no) (?:docs?|documentation|description|comment)s?\b"
    r"|^(?:write|insert|put) (?:a |the |some )?(?:proper )?(?:docs?|documentation|description|comment)s?\b|^(?:document|describe) (?:this|me|the (?:function|method))\b"
    r"|^(?:docs?|documentation|description) (?:goes|go) here\b|^lorem ipsum\b"
)
GENERATOR = (
    r"\bauto[- ]?generated\b|^generated (?:by|from|with|using)\b|\bcreated automatically\b|\bgenerated automatically\b|\bautomatically generated\b"
    r"|\bdo not (?:edit|modify) this\b|\bdo not edit\b|^created by .*\b(?:wizard|template|generator|tool)\b"
)
POINTER = (
    r"^see (?:also\b|above|below|base|the (?:documentation|docs|manual|readme|base|super|parent|interface)|https?:|\{?@|[\w.:#]+(?:\(\))?\W*$)"
    r"|^\W*@?inherit(?:ed)?[ _-]?docs?\b|^\{?@(?:see|link|linkplain|inheritdoc)\b[^}]*\}?\W*$|^refer to\b|^documented (?:in|at|elsewhere)\b|^(?:same as|as) above\b"
)
SWITCH = (
    r"^(?:swiftlint|eslint|tslint|jshint|jslint|pylint|nolint|noqa|flake8|mypy|type: ?ignore|rubocop|checkstyle|nosonar|sonar|clang-format|clang-tidy|clang-diagnostic"
    r"|prettier-ignore|istanbul|coverage|pragma|noinspection|suppresswarnings|@suppresswarnings|ts-(?:ignore|nocheck|expect-error)|@ts-\w+|biome-ignore|lint(?:er)?[:-]|go:(?:noinline|generate|build)|fmt: ?(?:on|off)|isort|ruff|cppcheck|nolintnextline|resharper)\b"
)
TAG = r"^(?:[@\\](?!brief\b|summary\b|details?\b|description\b|short\b|abstract\b|note\b|remarks?\b)\w+|:(?:param|parameter|arg|argument|type|return|returns|rtype|raise|raises|key|keyword|var|ivar|cvar|yields?)\b[^:]*:|- ?[A-Za-z_]\w*:|- (?:parameters?|returns?|throws)\b)"
CODE = (
    r"^[\w.$\[\]]+(?:, ?[\w.$]+)* ?(?::=|\+=|-=|=)(?!=) ?\S+|^(?:return|import|from|let|var|const|if|for|while|public|private|static|def|func|fn|package|using|#include)\b.*[;{(]\W*$"
    r"|^[\w.]+\([^)]*\);?$|[;{}]$|^>>> |^\$ "
)


def unmarked(line: Column) -> Column:
    """A line without comment markers, quotes of docstrings, XML and HTML tags and inline markup."""
    out = F.regexp_replace(line, r"\s*(?:\*+/|\"\"\"|''')?\s*$", "")
    out = F.regexp_replace(out, r"^\s*(?:/\*\*+|/\*!?|///?/?!?|--\[*|\*(?!\*)|#+!?|;+|\"\"\"|''')\s?", "")
    out = F.regexp_replace(out, r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>]*)?/?>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def kind_of(text: Column) -> Column:
    """The class of a remark by how it opens; ``text`` where it explains."""
    low = F.lower(F.regexp_replace(text, r"^[\s*#>\-–—=_.]+(?=\w)", ""))
    whole = F.lower(text)
    return (
        F.when(text == "", "blank")
        .when(~text.rlike(r"\p{L}"), "rule")
        .when(low.rlike(SWITCH) | whole.rlike(SWITCH), "switch")
        .when(low.rlike(REMINDER), "reminder")
        .when(low.rlike(PLACEHOLDER), "placeholder")
        .when(low.rlike(GENERATOR), "generator")
        .when(low.rlike(POINTER) | whole.rlike(POINTER), "pointer")
        .when(text.rlike(TAG), "tag")
        .when(text.rlike(CODE), "code")
        .otherwise("text")
    )


def name_words(name: Column) -> Column:
    """The words of an identifier in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z]+", " ")
    return F.split(F.lower(F.trim(spaced)), " +")


def remarks(docs: DataFrame, key: str = "id", text: str = "docstring") -> DataFrame:
    """(key, island, kind, words): the remarks of each text. Lines are exploded, a fence's parity marks code, and lines
    that go on (no new sentence, no blank or tag between) belong to the island of the line before.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).withColumn("raw", unmarked(F.col("raw")))
    # several sentences may stand on one line
    parts = lines.select(key, "line", F.posexplode(F.split("raw", r"(?<=[.!?;])\s+(?=[\p{Lu}@{])")).alias("part", "text"))
    order = Window.partitionBy(key).orderBy("line", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("fences", F.coalesce(F.sum(F.col("text").startswith("```").cast("int")).over(before), F.lit(0)))
    parts = parts.withColumn("kind", F.when((F.col("fences") % 2 == 1) | F.col("text").startswith("```"), "code").otherwise(kind_of(F.col("text"))))
    last, last_kind = F.lag("text").over(order), F.lag("kind").over(order)
    goes_on = (
        (F.col("kind") == "text")
        & last_kind.isin("text", "tag", "reminder", "generator", "placeholder", "pointer")
        & ~last.rlike(r"[.!?:;]\W*$")
        & F.col("text").rlike(r"^[\p{Ll}\d(]")
    )
    parts = parts.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    parts = parts.withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(order))
    bare = F.regexp_replace(F.col("text"), r"\{@\w+[^}]*\}|[@\\]\w+|https?://\S+|`[^`]*`", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace(bare, r"[^\p{L}\p{M}'’]+", " ")), " +"), lambda w: w.rlike(r"\p{L}"))
    per = parts.select(key, "island", "line", "part", "kind", words.alias("w"))
    return per.groupBy(key, "island").agg(
        F.min_by("kind", F.struct("line", "part")).alias("kind"), F.flatten(F.collect_list("w")).alias("words")
    )


def described(docs: DataFrame, key: str = "id", text: str = "docstring", name: str = "name", least: int = 4) -> DataFrame:
    """(key, explanation): the keys whose text explains something, with the number of explaining words."""
    own = docs.select(key, name_words(F.coalesce(F.col(name), F.lit(""))).alias("own"))
    told = remarks(docs, key, text).where("kind = 'text'").join(own, key)
    n = told.groupBy(key).agg(F.sum(F.size(F.filter("words", lambda w: ~F.array_contains(F.col("own"), w)))).cast("int").alias("explanation"))
    return n.where(F.col("explanation") >= least)


def description(text: Column) -> Column:
    """A docstring without its markup, lines kept, empty ones at the ends dropped."""
    lines = F.transform(F.split(text, "\n"), unmarked)
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))


# Lexers: one alternative per kind of token that carries structure; the text between is its gap.
_STRING = r"\"\"\"[\s\S]*?(?:\"\"\"|\z)|(?<hash>#+)\"[\s\S]*?(?:\"\k<hash>|\z)|\$?@\$?\"(?:[^\"]|\"\")*+\"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
_CHARACTER = r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|[^\n]{1,9}?))'"
_QUOTED = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_RAW = r"`[^`]*+`"  # no escapes, as in Go
# a template's inner expressions may hold braces and templates of their own
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*+`|\{[^{}`]*\})*+\})*+`"
_REGEX = r"(?<=[=(,:\[!&|?;{}])[ \t]*+/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_ANNOTATION = r"@[A-Za-z_][\w.]*+\s*+\((?:[^()\"'`]|\"[^\"\n]*+\"|'[^'\n]*+'|\((?:[^()]|\([^()]*+\))*+\))*+\)"  # may hold braces
_WORDS = (
    r"[{};]|=>|\b(?:if|for|foreach|while|switch|catch|class|interface|struct|enum|impl|namespace|package|import|return|new|else|do|try|extension|protocol|trait|guard|match|lock|using)\b"
    r"|[A-Za-z_$][\w$]*+(?=\s*+(?:<[^<>(){};]*+>)?\s*+\()"
)
#: A name that is given a function: an arrow or a function expression follows.
_ARROW = r"|[A-Za-z_$][\w$]*+(?=\s*+(?::[^=;{}\n]++)?=\s*+(?:async\b\s*+)?(?:function\b|(?:<[^<>(){};]*+>\s*+)?(?:\((?:[^()]|\([^()]*+\))*+\)|[A-Za-z_$][\w$]*+)\s*+(?::[^=;{}\n]++)?=>))"
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|"
#: The token patterns by language; all others with braces take the last one.
LEXERS = {
    ("javascript", "typescript", "tsx", "jsx"): _COMMENT + "|".join((_STRING, _TEMPLATE, _QUOTED, _REGEX, _ANNOTATION, _WORDS)) + _ARROW,
    ("php",): _COMMENT + "|".join((_STRING, _QUOTED, _ANNOTATION, _WORDS)),
    ("java", "go", "c", "cpp", "csharp", "swift", "rust", "kotlin", "scala", "zig"): _COMMENT + "|".join((_STRING, _RAW, _CHARACTER, _ANNOTATION, _WORDS)),
}
C_LIKE = tuple(lang for group in LEXERS for lang in group)
_BLOCK_WORDS = "if for foreach while switch catch class interface struct enum impl namespace package import return new else do try extension protocol trait guard match lock using".split()

#: Words that control blocks in some of the languages and may be names in the others.
_OWN_WORDS = ("match", "lock", "using", "guard", "extension", "protocol", "trait", "impl", "namespace", "foreach")
#: Of these, the ones that control blocks even where a bracket follows.
_STRICT = {"csharp": ("lock", "using", "foreach", "fixed"), "rust": ("match",), "swift": ("guard",)}


def _exploded(source: DataFrame, content: Column) -> DataFrame:
    """(file_id, language, pos, token, gap): ``content`` marks each token with \u0001 before and \u0002 after it."""
    one = source.select("file_id", "language", F.posexplode(F.split(content, "\u0001")).alias("pos", "part"))
    first = F.col("pos") == 0  # what stands before the first token
    return one.select(
        "file_id", "language", "pos", F.when(first, "").otherwise(F.substring_index("part", "\u0002", 1)).alias("token"),
        F.when(first, F.col("part")).otherwise(F.substring_index("part", "\u0002", -1)).alias("gap"),
    )


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n")))


def brace_functions(texts: DataFrame) -> DataFrame:
    """(file_id, name, signature, docstring, start_line, end_line) of functions in languages with braces.

    One pass: texts are brought together by file, everything after that is windows over its tokens, and only the rows of
    heads and braces are left when the pieces of a head are gathered. The documentation of a head is the last island of
    comments in its statement: comments of one style without a blank line between. Function bodies have braces.
    """
    source = texts.where(F.col("language").isin(*C_LIKE)).select("file_id", "language", F.translate(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\u0001\u0002", "  ").alias("content"))
    marked = F.lit(None).cast("string")
    for group, lexer in LEXERS.items():
        marked = F.when(F.col("language").isin(*group), F.regexp_replace("content", f"(?<token>{lexer})", "\u0001${token}\u0002")).otherwise(marked)
    order = Window.partitionBy("file_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.substring("token", 1, 1)
    kind = (
        F.when(F.col("token") == "", "gap").when(F.col("token").rlike(r"^//"), "line").when(F.col("token").rlike(r"^/\*"), "block")
        .when(F.col("token").isin("{", "}", ";"), F.col("token")).when(F.col("token") == "=>", "=>")
        .when(F.col("token").isin(*_OWN_WORDS) & F.col("gap").rlike(r"^\s*\("), "call").when(F.col("token").isin(*_BLOCK_WORDS), "word")
        .when(first.rlike("[A-Za-z_$]"), F.when(F.col("gap").rlike(r"^\s*(?:<[^<>]*>)?\s*\(") | F.col("gap").rlike(r"^\s*<"), "call").otherwise("arrow")).otherwise("literal")
    )
    tokens = _exploded(source, marked).withColumn("kind", kind).withColumn("nl", _newlines(F.col("token")) + _newlines(F.col("gap")))
    comment = F.col("kind").isin("line", "block")
    # a line's end closes a statement too, unless the text goes on, a body opens or a comment stands before it
    line_end = ~comment & (first != "@") & (F.col("gap").rlike(r"[^,(\s][ \t]*\n") | F.col("gap").rlike(r"^[ \t]*\n")) & (F.lead("token", 1, "").over(order) != "{")
    closes = F.col("kind").isin("{", "}", ";") | line_end
    tokens = tokens.withColumns({
        "line": (F.coalesce(F.sum("nl").over(before), F.lit(0)) + 1).cast("int"),
        "depth": F.sum(F.when(F.col("kind") == "{", 1).when(F.col("kind") == "}", -1).otherwise(0)).over(order),
        "closes": closes.cast("int"),
        # the first comment of an island: another style or none before it, a blank line between, or code before that on its line
        "fresh": (comment & ((F.lag("kind", 1, "").over(order) != F.col("kind")) | (F.col("kind") == "block") | F.lag("gap", 1, "").over(order).rlike(r"\n\s*\n|^[^\n]*\S"))).cast("int"),
        "trails": (comment & ~F.lag("gap", 1, "\n").over(order).rlike(r"\n") & ~F.lag("kind", 1, "line").over(order).isin("line", "gap")).cast("int"),
        "lead_in": F.when(F.lag("kind", 1, "gap").over(order).isin("{", "}", ";", "gap"), F.lag("gap", 1, "").over(order)).otherwise(""),
    })
    tokens = tokens.withColumns({
        "statement": F.coalesce(F.sum("closes").over(before), F.lit(0)), "island": F.sum("fresh").over(order), "level": F.col("depth") + F.when(F.col("kind") == "}", 1).otherwise(0),
    })
    own = Window.partitionBy("file_id", "statement").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    strict = F.lit(False)
    for lang, words in _STRICT.items():
        strict = strict | ((F.col("language") == lang) & F.col("token").isin(*words))
    at = lambda test: F.min(F.when(test, F.col("pos"))).over(own)
    tokens = tokens.withColumns({
        "arrow": at(F.col("kind") == "arrow"), "call": at(F.col("kind") == "call"), "arrows": at(F.col("kind") == "=>"), "control": at((F.col("kind") == "word") | ((F.col("kind") == "call") & strict)),
        "opens": at(F.col("kind") == "{"), "last_island": F.max(F.when(comment & (F.col("trails") == 0), F.col("island"))).over(own),
    })
    head = F.col("opens").isNotNull() & F.col("control").isNull() & (F.col("arrow").isNotNull() | (F.col("call").isNotNull() & F.col("arrows").isNull()))
    brace = F.col("kind").isin("{", "}")
    tokens = tokens.where(head | brace).withColumn("head", head)
    # a brace and its partner are neighbours on their level
    level = Window.partitionBy("file_id", F.when(brace, F.col("level")).otherwise(-1_000_000)).orderBy("pos")
    tokens = tokens.withColumn("end_line", F.when((F.col("kind") == "{") & (F.lead("kind").over(level) == "}"), F.lead("line").over(level))).where("head")
    text = F.when((F.col("kind") == "{") | comment, "").otherwise(F.concat("token", "gap"))
    text = F.when(comment, F.col("gap")).otherwise(F.concat("lead_in", text))
    named = F.col("pos") == F.coalesce("arrow", "call")
    joined = lambda test, value, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", value.alias("text"))))), lambda x: x["text"]), by)
    found = tokens.groupBy("file_id", "statement").agg(
        F.max(F.when(named, F.col("token"))).alias("name"), F.max(F.when(named, F.col("line"))).alias("start_line"), F.max("end_line").alias("end_line"),
        joined(comment & (F.col("island") == F.col("last_island")), F.col("token"), "\n").alias("docstring"), joined(F.lit(True), text, "").alias("signature"),
    ).where("end_line is not null")
    return found.select("file_id", "name", F.trim(F.regexp_replace("signature", r"\s+", " ")).alias("signature"), "docstring", "start_line", "end_line")


_LETTER = r"[\p{L}\p{N}_]"
_PYTHON = (
    r"#[^\n]*"
    rf"|(?:(?<!{_LETTER})[rRbBuUfFtT]{{1,2}})?+(?:\"\"\"[^\"\\]*+(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*+)*+(?:\"\"\"|\z)|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+(?:'''|\z)"
    r"|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')"
    rf"|\\\n|\n[ \t\f]*+|[()\[\]{{}}]|:(?!=)|(?<![\p{{L}}\p{{N}}_.])(?:(?:async[ \t]+)?def[ \t]+{_LETTER}+|(?:class|return|import|while|try|raise|pass|break|continue|del|global|assert)(?!{_LETTER}))"
)


def indent_functions(texts: DataFrame) -> DataFrame:
    """The same for Python: bracket depth tells the lines of statements from those that go on, a header ends at the first
    colon outside brackets, and a function ends before the next statement that is indented no deeper.

    Words that open statements only are never within brackets; where one begins a line, the depth starts anew, so a bracket
    left open in a damaged text costs no later function.
    """
    source = texts.where("language = 'python'").select("file_id", "language", F.concat(F.lit("\n"), F.translate(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\u0001\u0002", "  ")).alias("content"))
    # tokens and the text between them alternate; the line's end before the first line makes its lines like all others
    tokens = source.select("file_id", F.posexplode(F.split(F.regexp_replace("content", "(" + _PYTHON + ")", "\u0001$1\u0001"), "\u0001")).alias("pos", "token"))
    order = Window.partitionBy("file_id").orderBy("pos")
    first, real = F.substring("token", 1, 1), F.col("pos") % 2 == 1
    bare = F.regexp_replace("token", r"^[rRbBuUfFtT]{1,2}(?=[\"'])", "")
    kind = (
        F.when(~real, F.when(F.col("token").rlike(r"\S"), "code").otherwise("blank")).when(first == "\n", "newline").when(first == "\\", "blank").when(first == "#", "comment")
        .when(first.isin("(", "[", "{"), "open").when(first.isin(")", "]", "}"), "close").when(first == ":", "colon").when(bare.rlike("^[\"']"), "literal")
        .when(F.col("token").rlike(r"^(?:async[ \t]+)?def[ \t]"), "def").otherwise("word")
    )
    tokens = tokens.where(~(F.col("token") == "") | ~real).withColumn("kind", kind).withColumn("line", F.coalesce(F.sum(_newlines(F.col("token"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    written = F.when(~F.col("kind").isin("blank", "newline"), F.col("line") + _newlines(F.rtrim(F.regexp_replace("token", r"\s+\z", ""))))
    begins = F.col("kind").isin("def", "word") & (F.lag("token", 1).over(order) == "") & (F.lag("kind", 2).over(order) == "newline")
    tokens = tokens.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("before", F.max(written).over(order))
    tokens = tokens.withColumns({"block": F.sum(F.col("begins").cast("int")).over(order), "opens": F.coalesce(F.lead("begins", 2).over(order), F.lit(False))})
    block = Window.partitionBy("file_id", "block").orderBy("pos")
    nesting = F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(block)
    tokens = tokens.withColumns({
        "outside": nesting <= 0, "defines": F.max(F.col("begins") & (F.col("kind") == "def")).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "code": (F.lead("kind", 1).over(order) == "code") | ~F.coalesce(F.lead("kind", 2).over(order), F.lit("newline")).isin("newline", "comment"),
        "function": F.col("opens") & (F.lead("kind", 2).over(order) == "def"),
        "follows": F.concat(F.lead("kind", 1, "blank").over(order), F.lit(" "), F.lead("kind", 2, "newline").over(order), F.lit(" "), F.lead("token", 1, "").over(order)),
    })
    statement = (F.col("kind") == "newline") & F.col("code") & (F.col("outside") | F.col("opens"))
    file = Window.partitionBy("file_id")
    tokens = tokens.withColumns({
        "indent": F.when(statement, F.length("token") - 1), "last": F.max("before").over(file), "levels": F.collect_set(F.when(statement & F.col("function"), F.length("token") - 1)).over(file),
    })
    # statements by the indent of their first line; a function ends before the next one that is at its level or above.
    # The rows of headers stand beside them, on a level of their own.
    own, header = F.filter("levels", lambda x: x >= F.col("indent")), F.array(F.lit(-1))
    rows = tokens.where(F.col("indent").isNotNull() | F.col("defines"))
    rows = rows.withColumn("level", F.explode(F.when(F.col("indent").isNull(), header).when(F.col("defines"), F.concat(own, header)).otherwise(own))).drop("levels")
    level = Window.partitionBy("file_id", "level").orderBy("pos")
    rows = rows.withColumn("end_line", F.coalesce(F.lead("before").over(level), F.col("last")).cast("int"))
    rows = rows.where((F.col("level") == -1) | (F.col("function") & (F.col("level") == F.col("indent"))))
    mine = F.col("level") == -1
    rows = rows.withColumn("block", F.when(mine, F.col("block")).otherwise(F.col("block") + 1))

    # headers: the blocks that open with def, up to the colon; what stands first in the body may be a docstring
    whole = Window.partitionBy("file_id", "block")
    place = lambda kind: F.min(F.when(mine & F.col("outside") & (F.col("kind") == kind), F.col("pos"))).over(whole)
    heads = rows.withColumns({"colon": place("colon"), "stop": place("newline"), "def": F.min(F.when(mine & F.col("begins") & (F.col("kind") == "def"), F.col("pos"))).over(whole)})
    heads = heads.where("def is not null and colon is not null and (stop is null or colon < stop)")
    said = F.when(mine & (F.col("pos") <= F.col("colon")), F.when((F.col("kind") == "newline") | (F.col("token") == "\\\n"), " ").when(F.col("kind") == "comment", "").otherwise(F.col("token")))
    body = mine & (F.col("pos") > F.col("colon")) & ~F.col("kind").isin("blank", "newline", "comment")
    alone = (F.col("kind") == "literal") & F.col("follows").rlike(r"^blank (?:newline|comment) |^code \w+ \s*;") & F.col("token").rlike("^[rRuU]?[\"']")
    inner = F.regexp_replace("token", r"^[rRuU]?(?:\"\"\"([\s\S]*?)(?:\"\"\"|\z)|'''([\s\S]*?)(?:'''|\z)|\"([\s\S]*)\"|'([\s\S]*)')\z", "$1$2$3$4")
    found = heads.groupBy("file_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("pos", said.alias("said"))))), lambda x: x["said"]), "").alias("signature"),
        F.min(F.when(mine & (F.col("pos") == F.col("def")), F.col("line"))).alias("start_line"), F.max(F.when(~mine, F.col("end_line"))).alias("end_line"),
        F.min_by(F.when(alone, F.concat(F.lit('"""'), inner, F.lit('"""'))), F.when(body, F.col("pos"))).alias("docstring"),
    ).where(F.col("end_line").isNotNull() & F.col("signature").rlike(rf"def[ \t]+{_LETTER}+\s*[\[(]"))
    name = F.regexp_extract("signature", rf"def[ \t]+({_LETTER}+)", 1)
    return found.select("file_id", name.alias("name"), F.trim("signature").alias("signature"), F.coalesce("docstring", F.lit("")).alias("docstring"), "start_line", "end_line")


def functions(texts: DataFrame) -> DataFrame:
    """(file_id, name, signature, docstring, start_line, end_line) of the functions in whole texts of any of the languages."""
    texts = texts.where("content is not null and file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.lower("language").alias("language"), "content")
    texts = texts.dropDuplicates(["file_id"])  # the one exchange: the windows over a file's tokens need its rows together anyway
    return brace_functions(texts).unionByName(indent_functions(texts)).dropDuplicates(["file_id", "start_line", "name"])  # two of one name on a line count as one


def source_pairs(texts: DataFrame, least: int = 4) -> DataFrame:
    """(file_id, name, signature, description, start_line, end_line) of documented functions in whole texts.

    ``texts`` has file_id (one row each), language and content. Of two functions of one name on one line the first counts.
    """
    found = settled(functions(texts).where(F.col("docstring").rlike(r"\p{L}")), "functions")  # read three times
    key = ["file_id", "start_line", "name"]
    good = described(found.select(F.struct(*key).alias("id"), "docstring", "name"), least=least).select("id.*", "explanation")
    return found.join(good, key).select("file_id", "name", "signature", description(F.col("docstring")).alias("description"), "start_line", "end_line")


def symbol_pairs(symbols: DataFrame, texts: DataFrame, least: int = 4) -> DataFrame:
    """(id, name, signature, description, explanation) of the index's functions and methods that are documented.

    The functions and their documentation come from the tokens of the texts; a symbol is the function of its name that
    begins on its line of its file. Symbols that the index holds without signature or docstring give no pair, nor do
    those of files without text. Repeated symbols give one pair.
    """
    rows = symbols.where(F.col("kind").isin("function", "method") & F.col("id").isNotNull() & F.col("signature").rlike(r"\S") & F.col("docstring").rlike(r"\S"))
    rows = rows.select("id", "file_id", F.col("start_line").cast("int").alias("start_line"), "name", F.trim("signature").alias("signature")).dropDuplicates(["id"])
    found = functions(texts).where(F.col("docstring").rlike(r"\p{L}")).select("file_id", "start_line", "name", "docstring")
    both = settled(rows.join(found, ["file_id", "start_line", "name"]), "pairs")  # read three times
    good = described(both.select("id", "docstring", "name"), least=least)
    return both.join(good, "id").select("id", "name", "signature", description(F.col("docstring")).alias("description"), "explanation")
