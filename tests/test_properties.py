"""Property tests: column expressions against a plain-Python statement of the same rules."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from affinity.functions import purl, requirements

OPS = requirements.SPEC_OPERATORS
name = st.from_regex(r"[A-Za-z0-9][A-Za-z0-9._-]{0,8}", fullmatch=True)
version = st.from_regex(r"[0-9][0-9a-z.]{0,6}", fullmatch=True)
spec = st.tuples(st.sampled_from(OPS), version)
line = st.one_of(
    st.builds(lambda n, e, ss, sp: n + (f"[{e}]" if e else "") + sp + ", ".join(o + v for o, v in ss),
              name, st.sampled_from(["", "x", "a,b"]), st.lists(spec, max_size=3), st.sampled_from(["", " "])),
    st.sampled_from(["", "# comment", "-r other.txt", "$$$ junk $$$", "pkg ; python_version<'3'"]),
    st.text(alphabet="ab=<>!~ ,.#-;[]1", max_size=12),
)


def python_parse(text):
    s = text.strip()
    if not s or s.startswith("#") or s.startswith("-"):
        return None
    s = re.sub(r"\s+#.*$", "", s)
    s = re.sub(r";.*$", "", s).strip()
    m = re.match(requirements.LINE_PATTERN, s)
    if not m:
        return None
    specs = re.findall(requirements.SPEC_PATTERN, m.group(3) or "")
    return m.group(1), [tuple(x) for x in specs]


@settings(max_examples=60, deadline=None)
@given(st.lists(line, min_size=1, max_size=25))
def test_requirement_lines_match_python(spark, lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = {r.i: (None if r.req is None else (r.req.name, [tuple(s) for s in r.req.specs]))
           for r in requirements.parse_lines(df).collect()}
    assert got == {i: python_parse(t) for i, t in enumerate(lines)}


purls = st.builds(lambda e, n, v: f"pkg:{e}/{n}" + (f"@{v}" if v is not None else ""),
                  st.sampled_from(["npm", "pypi", "maven"]),
                  st.one_of(name, st.builds(lambda a, b: f"@{a}/{b}", name, name)),
                  st.one_of(st.none(), version, st.just("latest")))


@settings(max_examples=60, deadline=None)
@given(st.lists(purls, min_size=1, max_size=25))
def test_strip_to_major_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    got = {r.i: r.m for r in df.select("i", purl.strip_to_major("p").alias("m")).collect()}
    pat = re.compile(purl.MAJOR_VERSION_PATTERN)
    want = {i: (m.group() if (m := pat.search(v)) else "") for i, v in enumerate(values)}
    assert got == want
