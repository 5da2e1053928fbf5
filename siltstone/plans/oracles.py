"""DuckDB SQL for the rows of the queries, written apart from them."""

from __future__ import annotations

from ..functions import fixed
from ..operators.grounded import BASIS as BASIS_HEAD
from ..operators.grounded import CASES as CASES_HEAD
from ..operators.grounded import CLOSING, INSUFFICIENT, LEAD, NEAREST, NO_SOURCE
from .queries import ADD, ARTICLE, BASIS, CASES, CODE, DOMAINS, EVIDENCE as EVIDENCE_RULES, FACT_CLOSING, FACT_LEAD, FACTS, HINTS, INTENTS, K, MANY, NOISE, OVERVIEWS, REWRITE, SECTION, SECTIONS, STORAGE, THRESHOLD

_quoted = lambda xs: "(" + ", ".join("'" + x + "'" for x in xs) + ")"
IW, W = r"'[\p{L}\p{N}_À-ỹ]+'", r"'[\p{L}\p{N}_]+'"
tok = lambda c, rx=IW: f"regexp_extract_all(lower({c}), {rx})"
strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
collapse = lambda c: strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")
stopped = lambda x, stop: f"list_filter({x}, lambda w: length(w) > 1 and w not in {_quoted(stop)})"
keywords = lambda c: stopped(rf"regexp_split_to_array(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\-\[\]]', ' ', 'g'), '\s+')", fixed.METRIC_STOPWORDS)
answer_tokens = lambda c: stopped(f"list_distinct({tok(c)})", fixed.ANSWER_STOPWORDS)
shared = lambda a, b: f"len(list_intersect({a}, {b}))"


def cut(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


_plain = rf"regexp_replace(text, '(?s)---.*?---', ' ', 'g')"
for _mark in (r"(Điều\s+\d+\.)", r"(Chương\s+[IVXLC]+)"):
    _plain = rf"regexp_replace({_plain}, '{_mark}', chr(1) || '\1', 'g')"
_EVIDENCE = "list_transform(" + cut(collapse(_plain)) + r", lambda s: regexp_replace(s, '^[ \-•]+|[ \-•]+$', '', 'g'))"
EVIDENCE = f"list_filter({_EVIDENCE}, lambda s: length(s) between {fixed.SENTENCE_MIN} and {fixed.SENTENCE_MAX}" + "".join(f" and not contains(lower(s), '{m}')" for m in fixed.EVIDENCE_MARKERS)
EVIDENCE += r" and (not regexp_matches(s, '^\p{Ll}')" + "".join(f" or starts_with(lower(s), '{p}')" for p in fixed.LOWER_STARTS) + "))"


def words(expr: str) -> str:
    return f"select doc_id, cast(len(x) as bigint) n, md5(array_to_string(x, ' ')) digest from (select doc_id, {expr} x from documents)"


def unescape(c: str) -> str:
    """The references that the test tables have; the ampersand last and in one pass, as what it gives isn't read again."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


plain = lambda c: collapse(unescape(f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"))
CODE_FREE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<iframe\b.*?</iframe>', ' ', 'g')"
tag = lambda t: f"nullif({plain(rf'''regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1)''')}, '')"
TITLE = f"coalesce({tag('h1')}, {tag('title')}, 'Unknown title')"
TITLE_REGEX = f"coalesce(nullif({collapse(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title>(.*?)</title>' + chr(39) + ', 1))')}, ''), 'Untitled')"
_last_cut = r"regexp_replace(regexp_replace(p, '(?i)</p>|</article>', chr(1)), chr(1) || '(?s).*', '')"
BODIES = rf"""body_parts as (select page_id, url, html, list_filter(list_transform(string_split(regexp_replace(scope, '(?i)<p(?:\s[^>]*)?>', chr(2), 'g'), chr(2))[2:],
    lambda p: {plain(_last_cut)}), lambda t: length(t) >= {fixed.PARAGRAPH_MIN}) ps
  from (select *, case when regexp_matches(a, '(?i)<p[\s>]') then a else c end scope from (select *, regexp_extract(c, '(?is)<article\b[^>]*>(.*?)</article>', 1) a from (select *, {CODE_FREE} c from pages)))),
bodies as (select page_id, url, html, array_to_string(list_transform(list_filter(range(1, len(ps) + 1), lambda i: list_position(ps, ps[i]) = i), lambda i: ps[i]), chr(10) || chr(10)) body from body_parts)"""

QUERY = "q as (select item_id query_id, text query from benchmark)"
TOK = f"tk as (select doc_id, {tok('text')} t from documents), dl as (select doc_id, cast(len(t) as bigint) dl from tk), tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from tk) group by all), dfs as (select term, count(*) df from tf group by term), st as (select count(*) n, avg(dl) avgdl from dl)"
QT = f"qt as (select query_id, unnest({tok('query')}) term from q)"
_bm = lambda w: f"round(sum({w} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6)"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
RANKED = lambda src, k, idc="doc_id": f"select * from (select *, row_number() over (partition by query_id order by score desc, {idc}) rank from {src})" + (f" where rank <= {k}" if k else "")
BM = f"bs as (select query_id, doc_id, {_bm(IDF)} score from qt join tf using (term) join dfs using (term) join dl using (doc_id), st group by query_id, doc_id)"
_h = lambda t, at, n: f"('0x' || substr(md5({t}), {at}, {n}))::bigint"


def vecs(name: str, src: str, key: str) -> str:
    return f"{name}_w as (select {key}, {_h('term', 1, 8)} % {fixed.EMBEDDING_DIM} bucket, sum(case when {_h('term', 9, 2)} % 2 = 0 then 1.0::double else -1.0::double end) w from {src} group by all having w <> 0), {name} as (select {key}, bucket, w / sqrt(sum(w * w) over (partition by {key})) weight from {name}_w)"


DENSE = vecs("dv", "(select doc_id, unnest(t) term from tk)", "doc_id") + ", " + vecs("qv", "qt", "query_id") + ", dp as (select query_id, doc_id, sum(dv.weight * qv.weight) s from dv join qv using (bucket) group by query_id, doc_id), ds as (select query_id, doc_id, round(coalesce(s, 0), 6) + 0.0 score from (select query_id, doc_id from q, documents) left join dp using (query_id, doc_id))"
BASE = f"with {QUERY}, {TOK}, {QT}, {BM}"
BOTH = f"{BASE}, {DENSE}"


def lists(k: int) -> str:
    return f"{BOTH}, l0 as ({RANKED('ds', k)}), l1 as ({RANKED('bs', k)}), al as (select query_id, doc_id, score, rank, 0 list from l0 union all select query_id, doc_id, score, rank, 1 list from l1)"


RRF = f"rs as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score, max(score) raw from al group by query_id, doc_id)"
_f = lambda xs, x: f"len(list_filter({xs}, lambda y: y = {x}))"
_sq = lambda xs: f"coalesce(list_sum(list_transform(list_distinct({xs}), lambda x: power({_f(xs, 'x')}, 2))), 0)"
OVERLAP = lambda q, d: f"coalesce({shared(f'list_distinct({q})', d)} / nullif(len(list_distinct({q})), 0)::double, 0)"
COS = f"coalesce(coalesce(list_sum(list_transform(list_intersect(qw, dw), lambda x: {_f('qw', 'x')} * {_f('dw', 'x')})), 0)::double / nullif(sqrt({_sq('qw')} * {_sq('dw')}), 0), 0)"
CASE_TYPE = "case " + " ".join("when " + " or ".join(f"contains(lower(query), '{p}')" for p in ps) + f" then '{k}'" for k, ps in HINTS.items()) + " end"


KIND = "case when lang = 'en' then 'legal' when lang in ('fr', 'de') then 'news' else lang end"
has = lambda c, words: "(" + " or ".join(f"contains(lower({c}), '{w.lower()}')" for w in words) + ")"


def texts(src: str) -> str:
    return f"(select r.*, d.text, d.lang, d.source, {KIND} typ, q.query, {tok('q.query', W)} qw, {tok('d.text', W)} dw from {src} r join documents d using (doc_id) join q using (query_id))"


FORMULA = lambda src: f"(select query_id, doc_id, lang, query, round({fixed.W_OVERLAP} * {OVERLAP('qw', 'dw')} + {fixed.W_COSINE} * {COS} + {fixed.W_ORIGINAL} * score + {fixed.W_RANK} / (60 + rank), 6) score from {src})"
BOOST = lambda src: f"(select * replace (round(score + case when {CASE_TYPE} = lang then {fixed.DOMAIN_BOOST} else 0 end, 6) as score) from {src})"
FIRST = lambda src: f"(select * exclude (pn) from (select *, row_number() over (partition by query_id, left(text, 300) order by rank) pn from {src}) where pn = 1)"
LINEAR = lambda src: f"(select query_id, doc_id, round(0.7 * score + 0.3 * {OVERLAP('qw', 'dw')}, 6) score from {FIRST(src)})"
LENGTH = lambda src: f"(select query_id, doc_id, round(score + (length(text) % 10) * 0.01, 6) score from {src})"
def fallback(k: int = K) -> str:
    return f"vs as (select query_id, doc_id, round(count(*) / any_value(m)::double, 6) score from (select query_id, unnest(list_distinct({tok('query', W)})) term, len(list_distinct({tok('query', W)})) m from q) join (select doc_id, unnest(list_distinct({tok('text', W)})) term from documents) using (term) group by query_id, doc_id), vt as ({RANKED('vs', k)})"


FALLBACK = fallback()
GATED = f"g as (select query_id from fin group by query_id having max(score) >= {fixed.THRESHOLD}) select query_id, doc_id, score, rank, 'hybrid' retrieval_source from fin where query_id in (from g) union all select query_id, doc_id, score, rank, 'pageindex' from vt where query_id not in (from g)"
MERGED = "md as (select query_id, doc_id, score, row_number() over (partition by query_id order by list, rank) rank from (select *, row_number() over (partition by query_id, doc_id order by list, rank) n from al) where n = 1)"
def topped(k: int, threshold: float | None) -> str:
    """CTEs up to ``fr``, of which f0 and fr make the linear retrieval's rows: ``tp``."""
    cut_at = "" if threshold is None else f" where score >= {threshold}"
    return f"""{lists(2 * k)}, {MERGED}, f0 as (select * from ({RANKED(LINEAR(texts('md')), 2 * k)}){cut_at}), en as (select query_id from f0 group by query_id having count(*) >= {k}),
fa as (select query_id, doc_id, score, rank, 0 list from f0 where query_id not in (from en) union all select query_id, doc_id, score, rank, 1 list from l1 where query_id not in (from en)),
fm as (select query_id, doc_id, score, list, row_number() over (partition by query_id order by list, rank) rank from (select *, row_number() over (partition by query_id, doc_id order by list, rank) n from fa) where n = 1), fr as ({RANKED(LINEAR(texts('fm')), k)}),
tp as (select query_id, doc_id, score, rank, 'hybrid' retrieval_source from f0 where rank <= {k} and query_id in (from en) union all select query_id, doc_id, fr.score, fr.rank, case when list = 0 then 'hybrid' else 'pageindex' end from fr join fm using (query_id, doc_id))"""


TOP = f"{BASE}, lt as ({RANKED('bs', K)}), tt as (select * from {texts('lt')})"
CAND = f"{BASE}, lt as ({RANKED('bs', MANY)}), tt as (select * from {texts('lt')})"
PICK = "select query_id, doc_id, score, rank from"
POS = "(select *, row_number() over (partition by query_id order by case when c <= 2 or rank % 2 = 1 then rank else 2 * c + 2 - rank end) position from (select *, count(*) over (partition by query_id) c from tt))"
BONUS = f"case when typ = 'legal' and {has('query', EVIDENCE_RULES['legal'])} then 0.35 else 0 end + case when typ = 'news' and {has('query', EVIDENCE_RULES['news'])} then 0.35 else 0 end + case when contains(lower(source), '{EVIDENCE_RULES['law_source']}') and {has('query', EVIDENCE_RULES['law'])} then 0.30 else 0 end"


def evidence(src: str = "tt", at: str = "rank", bonus: str = BONUS) -> str:
    return f"""ev0 as (select query_id, query, {at} r, source, score cs, typ, i, s[i] sentence from (select *, s, unnest(range(1, len(s) + 1)) i from (select *, {EVIDENCE} s from {src}))),
ev1 as (select *, row_number() over (partition by query_id, lower(sentence) order by r, i) n from ev0),
ev2 as (select query_id, sentence, source, r, i, round(case when len({answer_tokens('sentence')}) > 0 then {shared(answer_tokens('query'), answer_tokens('sentence'))} / greatest(len({answer_tokens('query')}), 1)::double + 0.15 * cs + {bonus} else 0 end, 6) score from ev1 where n = 1),
ev as (select query_id, sentence, source, score, rank from (select *, row_number() over (partition by query_id order by score desc, r, i) rank from ev2 where score > 0) where rank <= {fixed.EVIDENCE_LIMIT})"""


EV = evidence()
REFUSE = "'No sufficient evidence was found.'"
ANSWER_TEMPLATE = "case when t.source is null then " + REFUSE + r" else 'According to [' || regexp_replace(t.source, '\.[A-Za-z0-9]+$', '') || '].' end"


def metrics(src: str) -> str:
    """Of rows with query, expected, answer, names (list) and bodies (list)."""
    cited = r"regexp_extract_all(lower(answer), '\[([^\]]+)\]', 1)"
    share = f"len(list_filter({cited}, lambda c: contains(lower(array_to_string(names, ' ')), c) or len(list_filter(string_split(c, ' '), lambda w: length(w) > 2 and contains(lower(array_to_string(names, ' ')), w))) > 0)) / nullif(len({cited}), 0)::double"
    text = "lower(array_to_string(list_transform(range(1, len(bodies) + 1), lambda i: bodies[i] || ' ' || names[i]), ' '))"
    e, qk = f"list_distinct({keywords('expected')})", f"list_distinct({keywords('query')})"
    return f"""(select * exclude (ctx, ek, qk), round((faithfulness + relevance + recall + precision) / 4, 6) average from (select *,
      round(case when coalesce(answer, '') = '' or len(bodies) = 0 then 0 when len({cited}) = 0 then 0.2 else greatest(0.5, {share}) end, 6) faithfulness,
      round(coalesce({shared('qk', keywords('answer'))} / nullif(len(qk), 0)::double, 1), 6) relevance,
      round(case when coalesce(expected, '') = '' or len(bodies) = 0 then 0 else coalesce(len(list_filter(ek, lambda w: contains(ctx, w))) / nullif(len(ek), 0)::double, 1) end, 6) recall,
      round(case when len(bodies) = 0 then 0 when len(qk) = 0 then 1 else len(list_filter(bodies, lambda b: len(list_filter(qk, lambda w: contains(lower(b), w))) >= least(2, len(qk)))) / len(bodies)::double end, 6) "precision"
      from (select *, {text} ctx, {e} ek, {qk} qk from {src})))"""


TURNS = "(select conv_id, turn, text query, e expected, a answer, list_filter([b1, b2], lambda x: x is not null) bodies, list_transform(list_filter([b1, b2], lambda x: x is not null), lambda x: 'turn') names from (select *, last_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) e, lead(text) over w a, lead(role) over w nr, lag(text, 1) over w b1, lag(text, 2) over w b2 from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant')"
EM = f"select conv_id, turn, faithfulness, relevance, recall, \"precision\", average from {metrics(TURNS)}"


def compared(config: str, src: str) -> str:
    return f"select '{config}' config, * from {metrics(f'(select q.query_id, query, expected, {ANSWER_TEMPLATE} answer, coalesce(b, []) bodies, coalesce(nm, []) names from q left join (select query_id, list(text order by rank) b, list(source order by rank) nm from {texts(src)} group by query_id) s using (query_id) left join (select query_id, source from {texts(src)} where rank = 1) t using (query_id))')}"


_HALVES = "string_split(coalesce(text, ''), ' ')"
GOLDEN = f"q as (select item_id query_id, array_to_string({_HALVES}[1:len({_HALVES}) // 2], ' ') query, array_to_string({_HALVES}[len({_HALVES}) // 2 + 1:], ' ') expected from benchmark)"
COMPARED = f"{lists(K)}, evals as ({compared('lexical', 'l1')} union all {compared('dense', 'l0')})".replace(QUERY, GOLDEN)
MEANS = ", ".join(f"round(avg({x}), 5) {x}" for x in ("faithfulness", "relevance", "recall", '"precision"', "average"))
_cells = " || ".join(f"printf(' | %.3f', {x})" for x in ("faithfulness", "relevance", "recall", '"precision"', "average")) + " || ' |'"

_sql_pieces = f"""pc as (select doc_id, list_filter(list_transform(case when length(t) <= 500 then [t] when contains(t, chr(10) || chr(10)) then string_split(t, chr(10) || chr(10)) when contains(t, chr(10)) then string_split(t, chr(10))
  when contains(t, '. ') then string_split(t, '. ') when contains(t, ' ') then string_split(t, ' ') else list_transform(range(1, length(t) + 1, 500), lambda i: substring(t, i, 500)) end, lambda x: {strip('x')}), lambda x: x <> '') ps from (select doc_id, {strip('text')} t from documents))"""
CHUNKS = f"""with recursive {_sql_pieces},
f as (select doc_id, ps, 1 k, []::varchar[] o, '' cur from pc union all
  select doc_id, ps, k + 1, case when length(s) > 500 then list_concat(list_concat(o, case when cur <> '' then [cur] else []::varchar[] end), list_transform(range(1, length(s) + 1, 450), lambda i: substring(s, i, 500)))
      when length(cand) <= 500 then o when cur <> '' then list_append(o, cur) else o end,
    case when length(s) > 500 then '' when length(cand) <= 500 then cand else {strip("right(cur, 50) || ' ' || s")} end
  from (select *, ps[k] s, case when cur <> '' then {strip("cur || ' ' || ps[k]")} else ps[k] end cand from f where k <= len(ps))),
r as (select doc_id, case when cur <> '' then list_append(o, cur) else o end o from f where k = len(ps) + 1)
select doc_id, i - 1 chunk_index, {strip('o[i]')} "content" from (select doc_id, o, unnest(range(1, len(o) + 1)) i from r) where {strip('o[i]')} <> ''"""

def intents(c: str = "query") -> dict[str, str]:
    out = {name: " and ".join(has(c, words) for words in lists) for name, lists in INTENTS.items()}
    out["prohibited"] = f"({out['prohibited']}) or ({out.pop('prohibited_acts')})"
    out["mixed"] = f"(({out['storage']}) or ({out['crime']}))"
    return out


MIXED = intents()["mixed"]
INTENT_COLUMNS = ", ".join(f"{c} {k}" for k, c in intents("q.query").items())
evidence_of_code = lambda src: f"(select query_id, bool_or({has(chr(99) + 'oncat_ws(chr(32), source, text)', CODE)}) code_evidence from {src} group by query_id)"
def quota(src: str) -> str:
    """CTEs up to ``q7``, the selection of ``src``."""
    return f"""q1 as (select *, typ = 'legal' and text <> '' lg, typ = 'news' nw, {MIXED} mx, typ = 'news' and {has('text', STORAGE)} sn from {src}),
q2 as (select *, min(case when lg then rank end) over (partition by query_id) a, max(sn) over (partition by query_id) an from q1),
q3 as (select x.*, y.text ft from q2 x left join q2 y on x.query_id = y.query_id and y.rank = x.a),
q4 as (select *, case when coalesce(lg and (rank = a or not contains(ft, left(text, 300))), false) then 0 when coalesce(mx and case when an then sn else nw end, false) then 1 else 2 end grp from q3),
q5 as (select *, min(grp) over (partition by query_id) < 2 sm from q4),
q6 as (select *, row_number() over (partition by query_id order by grp, rank) r2 from q5 where grp < 2 or not sm),
q7 as (select *, row_number() over (partition by query_id, left(text, 300) order by r2) n from q6 where r2 <= {K})"""


QUOTA = f"{CAND}, {quota('tt')} select query_id, doc_id, row_number() over (partition by query_id order by r2) rank from q7 where n = 1"
_keyword_sentences = lambda words, most: rf"list_filter(string_split(regexp_replace({collapse('text')}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 30 and regexp_matches(lower(s), '{'|'.join(words)}'))[1:{most}]"
_nl = "chr(10) || chr(10)"
STRUCTURED = f"""sa as (select *, {MIXED} mx, {has('text', STORAGE)} mn from tt),
sl as (select query_id, string_agg('{BASIS_HEAD} [Source ' || rank || ']:' || chr(10) || array_to_string(list_transform(s, lambda x: '- ' || x), chr(10)), chr(10) order by rank) legal from (select *, {_keyword_sentences(BASIS, 3)} s from sa where mx and typ = 'legal' and (mn or contains(text, '{ARTICLE}'))) where len(s) > 0 group by query_id),
sk as (select query_id, rank, ss[i] s, row_number() over (partition by query_id order by rank, i) n from (select query_id, rank, ss, unnest(range(1, len(ss) + 1)) i from (select *, {_keyword_sentences(CASES, 2)} ss from sa where mx and mn))),
sc as (select query_id, string_agg('- [Source ' || rank || '] ' || s, chr(10) order by n) cases from sk where n <= 5 group by query_id),
sn as (select query_id, string_agg('[Source ' || rank || '] ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || case when length(trim(text)) > 500 then left(trim(text), 500) || '...' else trim(text) end, chr(10) order by rank) nearest from sa where not mx and rank <= 3 group by query_id),
so as (select q.query_id, case when m.mx is null then {{refuse}} when m.mx then concat_ws({_nl}, '{LEAD}', legal, '{CASES_HEAD}' || chr(10) || cases, '{CLOSING}') else concat_ws({_nl}, '{NEAREST}', nearest) end answer
  from q left join (select query_id, bool_or(mx) mx from sa group by query_id) m using (query_id) left join sl using (query_id) left join sc using (query_id) left join sn using (query_id))""".replace("{refuse}", REFUSE)
INSUFFICIENT_SQL = lambda src, at: f"(select q.query_id, '{INSUFFICIENT.replace(chr(39), chr(39) * 2)}' || coalesce(nullif(names, ''), '{NO_SOURCE}') || '.' answer from q left join (select query_id, string_agg(source, ', ' order by r) names from (select query_id, source, min({at}) r from {src} where {at} <= 4 group by all) group by query_id) using (query_id))"


def hybrid(k: int, hints: dict, kind: str) -> str:
    """CTEs up to ``rh``, the rows of the hybrid retrieval."""
    wanted = "case " + " ".join("when " + has("query", ps) + f" then '{t}'" for t, ps in hints.items()) + " end"
    boost = lambda src: f"(select * replace (round(score + case when {wanted} = {kind} then {fixed.DOMAIN_BOOST} else 0 end, 6) as score) from {src})"
    formula = lambda src: FORMULA(src).replace("doc_id, lang, query", "doc_id, lang, typ, query")
    many = k * fixed.OVER_FETCH
    return f"{lists(many)}, {RRF}, rk as ({RANKED('rs', many)}), b1 as (from {boost(texts('rk'))}), b2 as ({RANKED('(select * exclude (rank) from b1)', 0)}), b3 as ({RANKED(formula('b2'), k)}), fin as ({RANKED('(select * exclude (rank) from ' + boost('b3') + ')', 0)}), {fallback(k)}, rh as (with {GATED})"


GENERATED = f"""{hybrid(8, DOMAINS, 'typ')}, tt as (select *, row_number() over (partition by query_id order by case when c <= 2 or rank % 2 = 1 then rank else 2 * c + 2 - rank end) pos from (select *, count(*) over (partition by query_id) c from {texts('rh')})),
{evidence('tt', 'pos', f"case when typ = 'legal' and {has('query', fixed.LEGAL_TERMS)} then 0.35 else 0 end")},
ga as (select query_id, string_agg('- ' || sentence || ' [' || source || ']', chr(10) order by rank) a from ev group by query_id),
gs as (select query_id, string_agg(doc_id, ',' order by rank) sources, min_by(retrieval_source, rank) retrieval_source from rh group by query_id)
select q.query_id, md5(case when gs.sources is null then {REFUSE} when {intents('q.query')['penalty']} and not code_evidence then i.answer else coalesce('{LEAD}' || chr(10) || a || chr(10) || '{CLOSING}', {REFUSE}) end) digest, coalesce(sources, '') sources, coalesce(retrieval_source, 'none') retrieval_source
from q left join ga using (query_id) left join gs using (query_id) left join {evidence_of_code('tt')} using (query_id) left join {INSUFFICIENT_SQL('tt', 'pos')} i using (query_id)"""

_least = lambda xs: "least(" + ", ".join(xs) + ")" if len(xs) > 1 else xs[0]


def section_sql(name: str, start: str, ends: list[str]) -> str:
    at = f"instr(text, '{start}')"
    rest = f"substring(text, {at} + {fixed.SECTION_SKIP})"
    stop = _least([f"nullif(instr({rest}, '{e}'), 0) + {fixed.SECTION_SKIP} - 1" for e in ends])
    return f"select doc_id, lang, source, '{name}' section, {at} \"at\", {strip(f'substring(text, {at}, coalesce({stop}, {fixed.SECTION_MOST}))')} \"content\" from documents where {at} > 0"


SECTION_TABLE = "sec as (from (" + " union all ".join(section_sql(s.name, s.start, s.ends) for s in SECTIONS) + ") where \"content\" <> '')"


def fact_cases(facts: list) -> list[tuple[str, str]]:
    line = lambda f: f"replace('{f.template}', '{{}}', nullif(regexp_extract({collapse('text')}, '{f.pattern}', 1), ''))"
    return [(n, "coalesce(" + ", ".join(line(f) for f in sorted(facts, key=lambda f: f.priority) if f.fact == n) + ")") for n in dict.fromkeys(f.fact for f in facts)]


def overview_sql(facts: list) -> str:
    """(doc_id, source, n_facts, overview)"""
    lines = "list_filter([" + ", ".join(c for _, c in fact_cases(facts)) + "], lambda x: x is not null)"
    return f"(select doc_id, source, len(ls) n_facts, '{FACT_LEAD}' || chr(10) || array_to_string(list_transform(ls, lambda x: '- ' || x || ' [' || source || ']'), chr(10)) || chr(10) || '{FACT_CLOSING}' overview from (select doc_id, coalesce(source, '') source, {lines} ls from documents) where len(ls) > 0)"


_first_overview = lambda k: f"(select min_by(overview, doc_id) from {overview_sql(OVERVIEWS[k].facts)} where contains(lower(source), '{OVERVIEWS[k].source}'))"
GROUNDED = f"""{TOP}, {EV}, ga as (select query_id, string_agg('- ' || sentence || ' [' || source || ']', chr(10) order by rank) a from ev group by query_id)
select q.query_id, md5(case when q.query_id not in (select query_id from tt) then {REFUSE} when {intents('q.query')['overview']} and {_first_overview('overview')} is not null then {_first_overview('overview')}
  when {intents('q.query')['decree_summary']} and {_first_overview('decree_summary')} is not null then {_first_overview('decree_summary')}
  when {intents('q.query')['penalty']} and not code_evidence then i.answer else coalesce('{LEAD}' || chr(10) || a || chr(10) || '{CLOSING}', {REFUSE}) end) digest
from q left join ga using (query_id) left join {evidence_of_code('tt')} using (query_id) left join {INSUFFICIENT_SQL('tt', 'rank')} i using (query_id)"""
_rewritten = lambda c: f"case when {intents(c)['prohibited']} or {intents(c)['storage']} then '{REWRITE}' when {intents(c)['crime']} then {c} || ' {ADD}' else {c} end"
_wanted = "case " + " ".join(f"when {' or '.join('(' + intents()[i] + ')' for i in s.intents)} then '{s.name}'" for s in SECTIONS) + " end"
_injected = f"(select query_id, doc_id, 1.0::double score, 0 rank, text, source, typ, query from (select item_id query_id, text query, {_wanted.replace('query', 'text')} w from benchmark) join (select section w, min_by(doc_id, doc_id) doc_id, min_by(\"content\", doc_id) text, min_by(source, doc_id) source, min_by({KIND}, doc_id) typ from sec group by section) using (w))"
QUOTA_ANSWERS = f"""{topped(30, None)}, {SECTION_TABLE}, q0 as (select item_id query_id, text query from benchmark),
rt as (select query_id, tp.doc_id, score, rank, d.text, d.source, {KIND} typ, q0.query from tp join documents d using (doc_id) join q0 using (query_id) union all from {_injected}), {quota('rt')},
q8 as (select query_id, query, doc_id, text, source, typ, row_number() over (partition by query_id order by r2) rank, count(*) over (partition by query_id) c from q7 where n = 1),
tt as (select * exclude (rank), row_number() over (partition by query_id order by case when c <= 2 or rank % 2 = 1 then rank else 2 * c + 2 - rank end) rank from q8), {STRUCTURED}
select query_id, md5(answer) digest, coalesce(s, '') sources, 'offline_fallback' model from so left join (select query_id, string_agg(source, ',' order by rank) s from tt group by query_id) using (query_id)""".replace(QUERY, f"q as (select item_id query_id, {_rewritten('text')} query from benchmark)", 1)

clean_text = lambda c: strip(rf"regexp_replace(regexp_replace(regexp_replace({unescape(c)}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_noise = lambda c: f"(length({c}) <= 2 or regexp_matches({c}, '^[0-9]{{1,3}}$') or {has(c, NOISE)})"
LINES = f"""ln as (select page_id, i - 1 line_no, {collapse(clean_text('ls[i]'))} line from (select page_id, ls, unnest(range(1, len(ls) + 1)) i from (select page_id, string_split(regexp_replace({CODE_FREE}, '(?s)<[^>]*>', chr(10), 'g'), chr(10)) ls from pages))),
lc as (select page_id, line_no, line from (select *, lag(line) over (partition by page_id order by line_no) b from ln where not {_noise('line')}) where line is distinct from b)"""
_near = lambda words: f"max({has('line', words)}) over (partition by page_id order by line_no rows between current row and {fixed.LOOK_AHEAD - 1} following)"
SECTIONS = f"""{LINES}, s1 as (select *, row_number() over (partition by page_id order by line_no) n, {_near(['is'])} nn, {_near(SECTION['decree'])} nd, {_near(SECTION['first'])} nf from lc),
s2 as (select *, coalesce(min(case when {has('line', SECTION['government'])} and nn and nd and nf then n end) over (partition by page_id),
  min(case when {has('line', ['is'])} and nd and nf then greatest(1, n - {SECTION['lead']}) end) over (partition by page_id), min(case when {has('line', SECTION['decree'])} and nf then greatest(1, n - {SECTION['lead']}) end) over (partition by page_id), 1) st from s1),
s3 as (select *, min(case when {has('line', SECTION['ends'])} and n >= st + {SECTION['least']} then n end) over (partition by page_id) en from s2),
sx as (select page_id, line_no, line from s3 where n >= st and (en is null or n < en)),
lt as (select page_id, case when length(c) < 200 and length(f) > length(c) then f else c end text from (select page_id, coalesce(c, '') c, coalesce(f, '') f from pages left join (select page_id, string_agg(line, chr(10) order by line_no) f from lc group by 1) using (page_id) left join (select page_id, string_agg(line, chr(10) order by line_no) c from sx group by 1) using (page_id)))"""
_news_markdown = f"'---' || chr(10) || 'title: ' || {TITLE} || chr(10) || 'source: ' || url || chr(10) || 'type: news' || chr(10) || '---' || chr(10) || chr(10) || '# ' || {TITLE} || chr(10) || chr(10) || body"
CHUNKED = f"select doc_id || ':' || chunk_index doc_id, doc_id d, chunk_index, \"content\" \"text\" from ({CHUNKS})"
ON_CHUNKS = lambda sql: sql.replace("from documents)", "from cdocs)").replace(f"with {QUERY}", f"with {QUERY}, cdocs as ({CHUNKED})").replace("from q, documents)", "from q, cdocs)")
TOPPED = f"{topped(K, THRESHOLD)} from tp"

_pages_text = lambda ts: strip(f"array_to_string(list_filter(list_transform(range(1, len({ts}) + 1), lambda i: case when {ts}[i] <> '' then '## Page ' || i || chr(10) || chr(10) || {ts}[i] end), lambda t: t is not null), chr(10) || chr(10))")
EXTRACTED = f"""with {BODIES}, {LINES}, x0 as (select page_id, 'paragraphs' m, 1 p, list_transform(list_filter(range(1, len(ps) + 1), lambda i: list_position(ps, ps[i]) = i), lambda i: ps[i]) ts from body_parts union all select page_id, 'lines', 2, [string_agg(line, chr(10) order by line_no)] from lc group by page_id union all select page_id, 'whole', 3, [{plain(CODE_FREE)}] from pages),
x1 as (select page_id, m, p, list_transform(ts, lambda t: {clean_text('t')}) ts from x0), x2 as (select *, {_pages_text('ts')} t from x1),
x3 as (select *, row_number() over (partition by page_id order by length(t) desc, p) n, string_agg(m || ':' || len(ts) || ':' || length(t), ',') over (partition by page_id order by p rows between unbounded preceding and unbounded following) a from x2)
select page_id, m "method", len(ts) pages, length(t) chars, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: i || ':' || length(ts[i])), ',') page_stats, md5(t) digest, a attempts from x3 where n = 1"""

_law = lambda title, method, text: f"'# ' || {title} || chr(10) || chr(10) || '- Source URL: ' || url || chr(10) || '- Source name: archive' || chr(10) || '- Crawl date: ' || chr(10) || '- Category: legal' || chr(10) || '- Extraction method: ' || {method} || chr(10) || '- Extracted characters: ' || length({text}) || case when {text} <> '' then chr(10) || chr(10) || {text} else '' end"
EVERYTHING = f"""{BODIES}, {SECTIONS}, la as (select page_id, url, {TITLE_REGEX} title, case when page_id % 2 = 0 and length(body) >= 1000 then 'paragraphs' else 'html_text_cleaned' end "method", case when page_id % 2 = 0 and length(body) >= 1000 then body else {strip('text')} end tx from lt join bodies using (page_id) where page_id % 3 = 0),
al2 as (select 'legal' kind, page_id, "method", length(tx) chars, case when length(tx) >= 1000 then 'ok' else 'too_short' end status, {_law('title', '"method"', 'tx')} md from la union all
  select 'news', page_id, case when body <> '' then 'paragraphs' else 'html_text' end, length(t), case when length(t) >= {fixed.NEWS_MIN} then 'ok' else 'short_content_warning' end, {_news_markdown} from (select *, case when body <> '' then body else {clean_text(plain(CODE_FREE))} end t from bodies) where page_id % 3 <> 0),
ev9 as (select kind, page_id, "method", chars, strlen(md) bytes, status, md from al2)"""

RETRIEVED_MAX = f"{lists(K)}, mm as (select query_id, doc_id, max(score) score from al group by all), fin as ({RANKED(LENGTH(texts('mm')), K)}), {FALLBACK}, {GATED}"

ORACLES = {
    "tokenize": words(tok("text")),
    "token_set": words(f"list_sort(list_distinct({tok('text', W)}))"),
    "answer_tokens": words(f"list_sort({answer_tokens('text')})"),
    "eval_keywords": words(keywords("text")),
    "evidence_sentences": words(EVIDENCE),
    "keyword_sentences": words(rf"list_filter(string_split(regexp_replace({collapse('text')}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 30 and regexp_matches(lower(s), 'the|der|que|les'))[1:3]"),
    "slugify": r"select page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'article') slug from pages",
    "safe_filename": r"select page_id, left(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '[^A-Za-z0-9]+', '_', 'g'), 80) \"name\" from pages".replace('\\"', '"'),
    "page_title": f"select page_id, {TITLE} title from pages",
    "page_title_regex": f"select page_id, {TITLE_REGEX} title from pages",
    "page_body": f"with {BODIES} select page_id, body from bodies",
    "metadata_header": f"select page_id, '---' || chr(10) || 'title: ' || {TITLE_REGEX} || chr(10) || 'source: ' || url || chr(10) || 'type: news' || chr(10) || '---' header from pages",
    "standardize_pages": f"with {BODIES} select page_id, '---' || chr(10) || 'title: ' || {TITLE} || chr(10) || 'source: ' || url || chr(10) || 'type: news' || chr(10) || '---' || chr(10) || chr(10) || '# ' || {TITLE} || chr(10) || chr(10) || body markdown from bodies",
    "load_documents": f"select doc_id chunk_id, source, coalesce(lang, 'unknown') \"type\", length({strip('text')}) n from documents where {strip('text')} <> ''",
    "chunk_recursive": CHUNKS,
    "chunk_fixed": "select doc_id, i - 1 \"start\", substring(text, i, 500) \"content\" from (select doc_id, text, unnest(range(1, length(text) + 1, 450)) i from documents)",
    "term_frequency": f"with {TOK} select doc_id, dl, term, tf from tf join dl using (doc_id)",
    "document_frequency": f"with {TOK} select term, df, round({IDF}, 6) idf from dfs, st",
    "corpus_stats": f"with {TOK} select n, round(avgdl, 6) avgdl from st",
    "hash_embedding": f"with {TOK}, {vecs('dv', '(select doc_id, unnest(t) term from tk)', 'doc_id')} select doc_id, cast(bucket as int) bucket, round(weight, 6) weight from dv",
    "bm25_search": f"{BASE} {RANKED('bs', MANY)}",
    "bm25_okapi": f"with {QUERY}, {TOK}, {QT}, ra as (select term, ln(n - df + 0.5) - ln(df + 0.5) raw from dfs, st), me as (select avg(raw) mean from ra), wi as (select term, case when raw < 0 then 0.25 * mean else raw end idf from ra, me), bs as (select query_id, doc_id, {_bm('idf')} score from qt join tf using (term) join wi using (term) join dl using (doc_id), st group by query_id, doc_id) {RANKED('bs', MANY)}",
    "dense_search": f"{BOTH} {RANKED('ds', MANY)}",
    "substring_search": rf"with {QUERY}, ss as (select query_id, doc_id, cast(len(list_filter(terms, lambda t: contains(lower(text), t))) as double) score from (select query_id, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda t: t <> '') terms from q), documents), sp as (select * exclude (m) from (select *, max(score) over (partition by query_id) m from ss) where score > 0 or m = 0) {RANKED('sp', K)}",
    "vectorless_search": f"with {QUERY}, {FALLBACK} select vt.*, left(text, {fixed.SNIPPET}) \"content\" from vt join documents using (doc_id)",
    "vector_topk": f"with v as (select vec_id, embedding::double[] e from embeddings), s as (select b.vec_id query_id, a.vec_id, round(case when sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) > 0 then list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) else 0 end, 6) score from v a, v b where b.vec_id % 50 = 0) {RANKED('s', 10, 'vec_id')}",
    "dot_product": "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 4) dot, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) norm from embeddings",
    "rrf_fusion": f"{lists(MANY)}, {RRF} {RANKED('rs', MANY)}",
    "max_merge": f"{lists(MANY)}, mm as (select query_id, doc_id, max(score) score from al group by all) {RANKED('mm', 0)}",
    "merge_dedupe": f"{lists(MANY)}, {MERGED} {PICK} md",
    "dedupe_prefix": f"{CAND} {PICK} {FIRST('tt')}",
    "rerank_formula": f"{CAND}, fr as (select query_id, doc_id, score from {FORMULA('tt')}) {RANKED('fr', K)}",
    "rerank_linear": f"{CAND}, fr as (from {LINEAR('tt')}) {RANKED('fr', K)}",
    "rerank_length_mod": f"{CAND}, fr as (from {LENGTH('tt')}) {RANKED('fr', K)}",
    "classify_query": f"with {QUERY} select query_id, {CASE_TYPE} \"type\" from q",
    "domain_boost": f"{CAND}, fr as (select query_id, doc_id, score from {BOOST('tt')}) {RANKED('fr', 0)}",
    "retrieve_hybrid": f"{lists(MANY)}, {RRF}, rk as ({RANKED('rs', MANY)}), b1 as (from {BOOST(texts('rk'))}), b2 as ({RANKED('(select * exclude (rank) from b1)', 0)}), b3 as ({RANKED(FORMULA('b2'), K)}), fin as ({RANKED('(select * exclude (rank) from ' + BOOST('b3') + ')', 0)}), {FALLBACK}, {GATED}",
    "retrieve_linear": TOPPED,
    "result_key": "select doc_id, md5(case when doc_id % 5 = 0 and doc_id % 7 = 0 then text else concat_ws('::', case when doc_id % 5 > 0 then source else '' end, case when doc_id % 7 > 0 then cast(doc_id as varchar) else '' end, left(text, 120)) end) digest from documents",
    "classify_intent": f"{TOP} select q.query_id, {INTENT_COLUMNS}, coalesce(code_evidence, false) code_evidence from q left join {evidence_of_code('tt')} using (query_id)",
    "chunk_predicates": f"select doc_id, coalesce({KIND} = 'legal', false) legal, coalesce({KIND} = 'news', false) news, coalesce({has('text', STORAGE)}, false) storage from documents",
    "quota_selection": QUOTA,
    "insufficient_answer": f"{TOP} from {INSUFFICIENT_SQL('tt', 'rank')}",
    "structured_answer": f"{TOP}, {STRUCTURED} select query_id, md5(answer) digest from so",
    "offline_answer": f"{TOP}, {STRUCTURED} select query_id, md5(answer) digest, coalesce(s, '') sources, 'offline_fallback' model from so left join (select query_id, string_agg(source, ',' order by rank) s from tt group by query_id) using (query_id)",
    "replace_refusals": f"{TOP}, {STRUCTURED}, us as (select query_id, bool_or(mx or mn or (typ = 'legal' and contains(text, '{ARTICLE}'))) u from sa group by query_id) select query_id, md5(case when query_id % 2 = 0 and coalesce(u, false) then answer when query_id % 2 = 0 then {REFUSE} else 'It is so.' end) digest, query_id % 2 = 0 and coalesce(u, false) replaced from so left join us using (query_id)",
    "generate": GENERATED,
    "section_between_markers": f"with {SECTION_TABLE} select doc_id, section, \"at\", length(\"content\") n, md5(\"content\") digest from sec",
    "fact_table": "from (" + " union all ".join(f"select doc_id, '{n}' fact, {c} line from documents" for n, c in fact_cases(FACTS)) + ") where line is not null",
    "fact_overview": f"select doc_id, n_facts, md5(overview) digest from {overview_sql(FACTS)}",
    "grounded_overview": GROUNDED,
    "rewrite_queries": f"select item_id query_id, {_rewritten('text')} query from benchmark",
    "generate_quota": QUOTA_ANSWERS,
    "conversion_report": f"with {BODIES} select 'news' kind, method, status, count(*) n, cast(sum(chars) as bigint) chars, cast(sum(bytes) as bigint) bytes from (select case when body <> '' then 'paragraphs' else 'html_text' end \"method\", length(t) chars, strlen(t) bytes, case when length(t) >= {fixed.NEWS_MIN} then 'ok' else 'short_content_warning' end status from (select *, case when body <> '' then body else {clean_text(plain(CODE_FREE))} end t from bodies)) group by all",
    "dedupe_consecutive_lines": f"with {LINES} from lc",
    "noise_lines": f"select page_id, cast(sum(case when {_noise('line')} then 1 else 0 end) as bigint) noise, count(*) n from (select page_id, {collapse(clean_text('r'))} line from (select page_id, unnest(string_split(html, chr(10))) r from pages)) group by page_id",
    "clean_text": f"select page_id, md5({clean_text('html')}) digest from pages",
    "legal_section": f"with {SECTIONS} from sx",
    "legal_texts": f"with {SECTIONS} select page_id, text, length(text) chars, case when length(text) >= 200 then 'ok' else 'too_short' end status from lt",
    "convert_all": f"with {BODIES}, {SECTIONS} select 'legal' kind, page_id, md5('---' || chr(10) || 'title: ' || {TITLE_REGEX} || chr(10) || 'source: ' || url || chr(10) || 'type: legal' || chr(10) || '---' || chr(10) || chr(10) || text) digest from lt join pages using (page_id) where page_id % 3 = 0 union all select 'news', page_id, md5({_news_markdown}) from bodies where page_id % 3 <> 0",
    "preferred_sources": f"with {BODIES}, {SECTIONS} select page_id, case when length(body) >= {fixed.NEWS_MIN} then 'paragraphs' else 'lines' end \"method\", md5(case when length(body) >= {fixed.NEWS_MIN} then body else text end) digest from bodies join lt using (page_id)",
    "index_join": f"with cdocs as ({CHUNKED}), {TOK.replace('from documents)', 'from cdocs)')}, {vecs('dv', '(select doc_id, unnest(t) term from tk)', 'doc_id')} select c.doc_id chunk_id, d doc_id, chunk_index, coalesce(n, 0) n, md5(text) digest from cdocs c left join (select doc_id, count(*) n from dv group by doc_id) using (doc_id)",
    "index_upserts": f"with udocs as (select doc_id, case when doc_id % 4 = 0 then 'Changed. ' || text else text end text from documents where doc_id % 10 <> 1), cdocs as ({CHUNKED.replace('from documents)', 'from udocs)')}), {TOK.replace('from documents)', 'from cdocs)')}, {vecs('dv', '(select doc_id, unnest(t) term from tk)', 'doc_id')} select c.doc_id chunk_id, d doc_id, chunk_index, coalesce(n, 0) n, md5(text) digest from cdocs c left join (select doc_id, count(*) n from dv group by doc_id) using (doc_id)",
    "embed_chunks": f"with cdocs as ({CHUNKED}), {TOK.replace('from documents)', 'from cdocs)')}, {vecs('dv', '(select doc_id, unnest(t) term from tk)', 'doc_id')} select c.doc_id chunk_id, coalesce(greatest(m, case when n < {fixed.EMBEDDING_DIM} then 0 else m end), 0) most, coalesce(n, 0) n from cdocs c left join (select doc_id, count(*) n, max(round(weight, 6)) m from dv group by doc_id) using (doc_id)",
    "bm25_indexed": ON_CHUNKS(f"{BASE} select query_id, doc_id chunk_id, score, rank from ({RANKED('bs', K)})"),
    "dense_indexed": ON_CHUNKS(f"{BOTH} select query_id, doc_id chunk_id, score, rank from ({RANKED('ds', K)})"),
    "retrieve_maxmerge": RETRIEVED_MAX,
    "normalize_source": f"select query_id, doc_id, retrieval_source source from ({RETRIEVED_MAX})",
    "reorder_for_llm": f"{TOP} select query_id, doc_id, rank, position from {POS}",
    "format_context": f"{TOP} select query_id, md5(string_agg(printf('[Document %d | Source: %s | Type: %s | Score: %.3f]', position, source, typ, round(score, 3)) || chr(10) || trim(text) || chr(10), chr(10) || '---' || chr(10) order by position)) digest from {POS} group by query_id",
    "build_prompt": f"{TOP} select query_id, md5('Context:' || chr(10) || string_agg('[Source ' || rank || ']' || chr(10) || trim(text), chr(10) || chr(10) order by rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || chr(10) || 'Answer:') digest from tt group by query_id",
    "answer_sources": f"{TOP} select query_id, string_agg(source, ',' order by r) sources from (select query_id, source, min(rank) r from tt where rank <= 4 group by all) group by query_id",
    "best_evidence": f"{TOP}, {EV} from ev",
    "extractive_answer": f"{TOP}, {EV} select query_id, coalesce(a, {REFUSE}) answer from q left join (select query_id, string_agg('- ' || sentence || ' [' || source || ']', chr(10) order by rank) a from ev group by query_id) using (query_id)",
    "template_answer": f"{TOP} select q.query_id, {ANSWER_TEMPLATE} answer from q left join (select query_id, source from tt where rank = 1) t using (query_id)",
    "eval_metrics": EM,
    "eval_compare": f"{COMPARED} select config, {MEANS} from evals group by config",
    "evaluation_report": f"""{COMPARED}, mean as (select config, {MEANS} from evals group by config), low as (select * from evals order by average, query_id limit 3),
rl as (select 0 p, '' k, '| config | faithfulness | relevance | recall | precision | average |' line union all select 1, '', '|---|---|---|---|---|---|' union all select 2, config, '| ' || config || {_cells} from mean
  union all select 3, '', '' union all select 4, '', '| query | faithfulness | relevance | recall | precision | average |' union all select 5, '', '|---|---|---|---|---|---|' union all select 6, printf('%.6f %012d', average, query_id), '| ' || query_id || {_cells} from low)
select row_number() over (order by p, k) line_no, line from rl""",
    "best_extraction": EXTRACTED,
    "vectorless_relabel": f"{BASE} select *, 'pageindex' retrieval_source, 'local_lexical' fallback from ({RANKED('bs', K)})",
    "legal_markdown": f"with {SECTIONS} select page_id, length({strip('text')}) chars, md5({_law(TITLE_REGEX, chr(39) + 'html_text_cleaned' + chr(39), strip('text'))}) digest from lt join pages using (page_id) where page_id % 3 = 0",
    "convert_everything": f"with {EVERYTHING} select kind, page_id, \"method\", chars, bytes, status, md5(md) digest from ev9",
    "everything_report": f"with {EVERYTHING} select kind, \"method\", status, count(*) n, cast(sum(chars) as bigint) chars, cast(sum(bytes) as bigint) bytes from ev9 group by kind, \"method\", status",
    "config_deltas": f"{COMPARED}, means as (select config, {MEANS.replace('round(', '(').replace(', 5)', ')')} from evals group by config), long as (unpivot means on faithfulness, relevance, recall, \"precision\", average into name metric value v) select metric, round(max(case when config = 'lexical' then v end), 5) lexical, round(max(case when config = 'dense' then v end), 5) dense, round(max(case when config = 'lexical' then v end) - max(case when config = 'dense' then v end), 5) delta from long group by metric",
    "config_worst": f"{COMPARED} select query_id, faithfulness, relevance, recall, \"precision\", average from evals where config = 'dense' order by average, query_id limit 3",
    "worst_performers": f"select conv_id, turn, average from ({EM}) order by average, conv_id * 1000 + turn limit 3",
    "chat_history": "select conv_id, turn, role, row_number() over w place, lag(role) over w \"before\", length(text) n from conversations window w as (partition by conv_id order by turn)",
}
