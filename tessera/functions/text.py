"""Text expressions: answers and their accuracy, white space, names, mentions, prompts, search text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the public VQA evaluation: number words, articles, marks and contractions.
DIGITS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
PERIODS = 32
CONTRACTIONS = {
    "'ow'sat": "'ow's'at",
    "'ows'at": "'ow's'at",
    "I'dve": "I'd've",
    "Id've": "I'd've",
    'Im': "I'm",
    'Ive': "I've",
    'aint': "ain't",
    'arent': "aren't",
    'cant': "can't",
    "couldn'tve": "couldn't've",
    'couldnt': "couldn't",
    "couldnt've": "couldn't've",
    'couldve': "could've",
    'didnt': "didn't",
    'doesnt': "doesn't",
    'dont': "don't",
    "hadn'tve": "hadn't've",
    'hadnt': "hadn't",
    "hadnt've": "hadn't've",
    'hasnt': "hasn't",
    'havent': "haven't",
    "he'dve": "he'd've",
    'hed': "he'd",
    "hed've": "he'd've",
    'hes': "he's",
    'howd': "how'd",
    'howll': "how'll",
    'hows': "how's",
    'isnt': "isn't",
    "it'dve": "it'd've",
    'itd': "it'd",
    "itd've": "it'd've",
    'itll': "it'll",
    "let's": "let's",
    'maam': "ma'am",
    "mightn'tve": "mightn't've",
    'mightnt': "mightn't",
    "mightnt've": "mightn't've",
    'mightve': "might've",
    'mustnt': "mustn't",
    'mustve': "must've",
    'neednt': "needn't",
    'notve': "not've",
    'oclock': "o'clock",
    'oughtnt': "oughtn't",
    "ow's'at": "'ow's'at",
    'shant': "shan't",
    "she'dve": "she'd've",
    "she's": "she's",
    "shed've": "she'd've",
    "shouldn'tve": "shouldn't've",
    'shouldnt': "shouldn't",
    "shouldnt've": "shouldn't've",
    'shouldve': "should've",
    "somebody'd": 'somebodyd',
    "somebody'dve": "somebody'd've",
    "somebodyd've": "somebody'd've",
    'somebodyll': "somebody'll",
    'somebodys': "somebody's",
    "someone'dve": "someone'd've",
    'someoned': "someone'd",
    "someoned've": "someone'd've",
    'someonell': "someone'll",
    'someones': "someone's",
    "something'dve": "something'd've",
    'somethingd': "something'd",
    "somethingd've": "something'd've",
    'somethingll': "something'll",
    'thats': "that's",
    "there'dve": "there'd've",
    'thered': "there'd",
    "thered've": "there'd've",
    'therere': "there're",
    'theres': "there's",
    "they'dve": "they'd've",
    'theyd': "they'd",
    "theyd've": "they'd've",
    'theyll': "they'll",
    'theyre': "they're",
    'theyve': "they've",
    'twas': "'twas",
    'wasnt': "wasn't",
    "we'dve": "we'd've",
    "wed've": "we'd've",
    'werent': "weren't",
    'weve': "we've",
    'whatll': "what'll",
    'whatre': "what're",
    'whats': "what's",
    'whatve': "what've",
    'whens': "when's",
    'whered': "where'd",
    'wheres': "where's",
    'whereve': "where've",
    "who'dve": "who'd've",
    'whod': "who'd",
    "whod've": "who'd've",
    'wholl': "who'll",
    'whos': "who's",
    'whove': "who've",
    'whyll': "why'll",
    'whyre': "why're",
    'whys': "why's",
    'wont': "won't",
    "wouldn'tve": "wouldn't've",
    'wouldnt': "wouldn't",
    "wouldnt've": "wouldn't've",
    'wouldve': "would've",
    "y'all'dve": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'allll": "y'all'll",
    'yall': "y'all",
    "yall'd've": "y'all'd've",
    "yall'll": "y'all'll",
    "you'dve": "you'd've",
    'youd': "you'd",
    "youd've": "you'd've",
    'youll': "you'll",
    'youre': "you're",
    'youve': "you've",
}


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _lookup(table: dict[str, str], word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, word), word)


def strip_marks(text: Column) -> Column:
    """Marks go where any stands next to a blank or digits have a comma between them, and become blanks elsewhere; the first PERIODS periods that no digit follows go too."""
    digits = text.rlike(r"\d,\d")
    out = text
    for m in MARKS:
        goes = F.contains(text, F.lit(m + " ")) | F.contains(text, F.lit(" " + m)) | digits
        out = F.replace(out, F.lit(m), F.when(goes, "").otherwise(" "))
    parts = F.split(out, r"\.(?!\d)")
    rest = F.slice(parts, PERIODS + 2, 1 << 30)
    return F.concat(F.array_join(F.slice(parts, 1, PERIODS + 1), ""), F.when(F.size(rest) > 0, F.concat(F.lit("."), F.array_join(rest, "."))).otherwise(""))


def plain_words(text: Column) -> Column:
    """Lower-cased words, with number words as digits, without articles, with contractions spelled as usual."""
    digits = F.transform(_words(F.lower(text)), lambda w: _lookup(DIGITS, w))
    kept = F.filter(digits, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: _lookup(CONTRACTIONS, w)), " ")


def vqa_accuracy(candidate: Column, answers: Column) -> Column:
    """Mean over the human answers of min(1, matches among the others / 3); texts are normalised if the humans disagree; null without answers."""
    tidy = lambda c: F.trim(F.translate(c, "\n\t", "  "))
    truth, guess = F.transform(answers, tidy), tidy(candidate)
    differ = F.size(F.array_distinct(truth)) > 1
    norm = lambda c: plain_words(strip_marks(c))
    truth = F.when(differ, F.transform(truth, norm)).otherwise(truth)
    guess = F.when(differ, norm(guess)).otherwise(guess)
    same, n = F.size(F.filter(truth, lambda a: a == guess)).cast("double"), F.size(truth)
    one = lambda c: F.least(F.lit(1.0), c / 3)
    return F.when(n > 0, (same * one(F.greatest(same - 1, F.lit(0.0))) + (n - same) * one(same)) / n)


def clean_answer(text: Column) -> Column:
    """The first line with text, without an "Answer:" before it and quotes around it."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^\s*(?:final\s+)?answer\s*[:\-]\s*", "")))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return F.coalesce(F.trim(F.regexp_replace(first, r"^[\"'`]+|[\"'`]+$", "")), F.lit(""))


def json_reply(text: Column, schema: str) -> Column:
    """A reply as a struct: as it is, from a code fence, or from the outermost braces; null if none is an object."""
    bare = F.trim(text)
    fenced = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    good = [F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.trim(c), F.lit("{")), c) for c in (bare, fenced, braces)]
    return F.from_json(F.coalesce(*good), schema)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def search_text(text: Column, question: Column, source_json: Column) -> Column:
    """What search looks at, lower-cased; stored with a snapshot."""
    return F.lower(F.concat_ws("\n", F.coalesce(text, F.lit("")), F.coalesce(question, F.lit("")), F.coalesce(source_json, F.lit("{}"))))


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced; lists are joined by a bar; missing values are empty."""
    return reduce(lambda out, kv: F.replace(out, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), F.lit(template))


def bar_joined(items: Column) -> Column:
    return F.array_join(items, " | ")


def turns(pairs: Column) -> Column:
    """[{user, assistant}] to a list of role and content in turn."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.flatten(F.transform(pairs, lambda p: F.array(turn("user", p["user"]), turn("assistant", p["assistant"]))))


def contains_all_words(text: Column, term: str) -> Column:
    """Whether each word of ``term`` occurs in the text, whatever the case."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(w)) for w in term.lower().split()], F.lit(True))


def mentions(documents: DataFrame, id_column: str, text_column: str, names: str, context: str) -> DataFrame:
    """id, line, name, in_context: matches of the pattern ``names`` by line; in context if the line or a neighbour of it matches ``context``.

    Lines stay within their document's row: no window over lines, and no shuffle."""
    rows = documents.select(F.col(id_column).alias("id"), F.split(text_column, r"\n").alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_extract_all(x, F.lit(names), F.lit(0)).alias("names")))
    rows = rows.select("id", "lines", F.filter(each, lambda x: F.size(x["names"]) > 0).alias("found")).where(F.size("found") > 0)  # only lines with names leave their row
    near = lambda i: F.exists(F.slice(F.col("lines"), F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), lambda x: x.rlike(context))
    found = rows.select("id", F.explode(F.transform("found", lambda x: F.struct((x["i"] + 1).alias("line"), near(x["i"]).alias("in_context"), x["names"].alias("names")))).alias("x"))
    return found.select("id", "x.line", "x.in_context", F.explode("x.names").alias("name")).select("id", "line", "name", "in_context")


def group_mentions(found: DataFrame) -> DataFrame:
    """key (lower-cased name), aliases, papers (ids), mention_ids (id:line:place in the line's mentions), documents, mentions; lists are sorted.

    Names are grouped within their document first, so that a common name gathers a row a document."""
    place = F.row_number().over(Window.partitionBy("id", "line").orderBy("name"))
    each = found.withColumn("_m", F.concat_ws(":", "id", "line", place)).groupBy(F.lower("name").alias("key"), "id")
    each = each.agg(F.collect_set("name").alias("_a"), F.collect_list("_m").alias("_m"))
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return each.groupBy("key").agg(listed("_a").alias("aliases"), F.array_sort(F.collect_list("id")).alias("papers"), listed("_m").alias("mention_ids"), F.count(F.lit(1)).alias("documents"), F.sum(F.size("_m")).alias("mentions"))


def sections(lines: DataFrame, group: str, order: str, heading: Column) -> DataFrame:
    """``section``: the last heading at or before each line."""
    last = F.last(F.when(heading, F.col("line_text")), ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", last)
