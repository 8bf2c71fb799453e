"""DuckDB SQL for the queries over the given tables."""

from __future__ import annotations

from clipgrain.functions import tokens
from clipgrain.operators import requests as Q
from clipgrain.plans import adapters as A
from clipgrain.sources import reference_data as R


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(table: dict[str, str]) -> str:
    """A small fixed map, to be indexed."""
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in table.items()) + "}"


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) {names}"


def _counts() -> str:
    plain = "regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"
    cases = []
    for lang, rules in A.REWRITES.items():
        own = plain
        for a, b in rules:
            own = f"replace({own}, {text(a)}, {text(b)})"
        cases.append(f"WHEN {text(lang)} THEN {own}")
    dropped = ", ".join(map(text, R.NON_PHONEMES))
    return f"""tok AS (SELECT doc_id AS clip_id, lang, unnest(string_split(CASE lang {" ".join(cases)} ELSE {plain} END, '')) AS symbol FROM documents),
    counts AS (SELECT clip_id, lang, symbol, count(*) AS n FROM tok WHERE symbol NOT IN ({dropped}) GROUP BY ALL),
    inv AS (SELECT clip_id, lang, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL)"""


def _markers() -> str:
    rows = R.marker_rows()
    head = values([(lang, side, i, label, least, optional) for lang, side, i, label, least, optional, _ in rows], "m(profile, side, ord, label, least, optional)")
    variants = values([(lang, side, i, v) for lang, side, i, _, _, _, vs in rows for v in vs], "v(profile, side, ord, variant)")
    names = values(sorted(R.profile_index().items()), "p(name, profile)")
    return f"markers AS (SELECT * FROM {head}), variants AS (SELECT * FROM {variants}), names AS (SELECT * FROM {names})"


def _match(profiles: str) -> str:
    """``profiles`` gives clip_id, total and profile."""
    return f"""WITH {_counts()}, {_markers()}, asked AS ({profiles}),
    hit AS (SELECT a.clip_id, a.profile, v.side, v.ord, sum(c.n) AS n FROM asked a JOIN variants v USING (profile) JOIN counts c ON c.clip_id = a.clip_id AND c.symbol = v.variant GROUP BY ALL),
    judged AS (SELECT a.clip_id, a.profile, a.total, m.side, m.ord, m.label, m.optional,
               CASE WHEN m.side = 'positive' THEN coalesce(h.n, 0) >= m.least ELSE coalesce(h.n, 0) <= m.least END AS passed
               FROM asked a JOIN markers m USING (profile) LEFT JOIN hit h ON h.clip_id = a.clip_id AND h.profile = a.profile AND h.side = m.side AND h.ord = m.ord),
    sums AS (SELECT clip_id, profile, total, count(*) FILTER (side = 'positive' AND passed) AS h, count(*) FILTER (side = 'positive' AND (passed OR NOT optional)) AS b,
             count(*) FILTER (side = 'positive') AS pt, count(*) FILTER (side = 'negative' AND passed) AS c, count(*) FILTER (side = 'negative') AS nt FROM judged GROUP BY ALL),
    scored AS (SELECT *, CASE WHEN total >= {R.MIN_TOKENS} THEN CAST({R.POSITIVE_WEIGHT} AS DOUBLE) * (CASE WHEN b > 0 THEN h / b ELSE 1.0 END) + CAST({R.NEGATIVE_WEIGHT} AS DOUBLE) * (CASE WHEN nt > 0 THEN c / nt ELSE 1.0 END) END AS s FROM sums)"""


_SCORED = f"""SELECT clip_id, profile, CASE WHEN s IS NULL THEN 'insufficient_signal' WHEN s >= {R.MATCHES_AT} THEN 'matches' WHEN s < {R.MISMATCH_BELOW} THEN 'mismatch' ELSE 'uncertain' END AS verdict,
    round(s, 6) AS score, CASE WHEN s IS NULL THEN 0 ELSE h END AS positive_hits, CASE WHEN s IS NULL THEN pt ELSE b END AS positive_total, CASE WHEN s IS NULL THEN 0 ELSE c END AS negative_clean, nt AS negative_total FROM scored"""


def _ipa() -> str:
    names = values([(n.symbol, n.ipa) for n in R.alphabet()], "a(symbol, ipa)")
    near = values(R.confusion_rows(), "e(target, ord, from_symbol, weight)")
    return f"""WITH {_counts()}, ipa AS (SELECT clip_id, coalesce(a.ipa, counts.symbol) AS symbol, CAST(sum(n) AS BIGINT) AS n FROM counts LEFT JOIN (SELECT * FROM {names}) a ON a.symbol = counts.symbol GROUP BY ALL),
    near AS (SELECT target, ord, from_symbol, CAST(weight AS DOUBLE) AS weight FROM {near}),
    ev AS (SELECT clip_id, target, ord, from_symbol, n AS raw_count, weight, weight * n AS contribution FROM ipa JOIN near ON near.from_symbol = ipa.symbol WHERE n > 0)"""


_US = "epoch_us(ts)"
_PITCH = f"pitch AS (SELECT user_id AS clip_id, event_id, event_type, {_US} AS time_us, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS f0 FROM events)"


def _f0(keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (f0 > 0) AS voiced, avg(f0) FILTER (f0 > 0) AS mean_hz, min(f0) FILTER (f0 > 0) AS min_hz, max(f0) FILTER (f0 > 0) AS max_hz, stddev_pop(f0) FILTER (f0 > 0) AS std_hz,
    stddev_pop(CASE WHEN f0 > 0 THEN 12 * log2(f0 / 100) END) AS std_st, quantile_cont(CASE WHEN f0 > 0 THEN 12 * log2(f0 / 100) END, 0.9) - quantile_cont(CASE WHEN f0 > 0 THEN 12 * log2(f0 / 100) END, 0.1) AS r, avg(CASE WHEN f0 > 0 THEN 1.0 ELSE 0.0 END) AS vf FROM pitch GROUP BY ALL"""


def _five(c: str, name: str) -> str:
    return f"round(CASE WHEN voiced >= 5 THEN {c} END, 6) AS {name}"


def _features() -> str:
    buckets = values(list(A.BUCKET_OF_EVENT.items()), "b(event_type, bucket)")
    groups = values(list(R.LEANING.items()), "l(bucket, leaning)")
    return f"""WITH {_PITCH}, f AS ({_f0("clip_id, event_type")}),
    clips AS (SELECT clip_id, bucket, leaning, CASE WHEN clip_id % 2 <> 0 THEN 'male' ELSE 'female' END AS gender, CASE WHEN voiced >= 5 THEN std_hz END AS std_hz, CASE WHEN voiced >= 5 THEN std_st END AS st
              FROM f JOIN (SELECT * FROM {buckets}) USING (event_type) JOIN (SELECT * FROM {groups}) USING (bucket)),
    cut AS (SELECT round(avg(st) FILTER (leaning = 'flat-leaning'), 1) AS lo, round(avg(st) FILTER (leaning = 'expressive-leaning'), 1) AS hi FROM clips),
    cls AS (SELECT clips.*, CASE WHEN std_hz IS NULL THEN 'n/a' WHEN std_hz < {R.HZ_LOW} THEN 'flat' WHEN std_hz <= {R.HZ_HIGH} THEN 'moderate' ELSE 'expressive' END AS hz_class,
            CASE WHEN st IS NULL THEN 'n/a' WHEN st < coalesce(lo, 0) THEN 'flat' WHEN st <= coalesce(hi, 0) THEN 'moderate' ELSE 'expressive' END AS st_class FROM clips, cut)"""


def _summary(keys: str) -> str:
    q = lambda p, n: f"round(quantile_cont(st, {p}), 6) AS {n}"
    return f"{_features()} SELECT {keys}, count(st) AS n, round(avg(st), 6) AS mean, {q(0.5, 'median')}, {q(0.1, 'p10')}, {q(0.25, 'p25')}, {q(0.75, 'p75')}, {q(0.9, 'p90')}, round(min(st), 6) AS min, round(max(st), 6) AS max, round(stddev_pop(st), 6) AS stdev FROM clips WHERE st IS NOT NULL GROUP BY ALL"


def _vot() -> str:
    phonemes = values(list(A.STOP_OF_EVENT.items()), "p(event_type, phoneme)")
    classes = values([(s.symbol, s.aspiration) for s in R.STOPS], "c(phoneme, aspiration_class)")
    w = A.WINDOW_US
    return f"""WITH {_PITCH}, stops AS (SELECT clip_id, event_id AS stop_id, phoneme, aspiration_class, time_us AS t FROM pitch JOIN (SELECT * FROM {phonemes}) USING (event_type) JOIN (SELECT * FROM {classes}) USING (phoneme)),
    voiced AS (SELECT clip_id, time_us AS v FROM pitch WHERE f0 > 0 AND event_type NOT IN (SELECT event_type FROM {phonemes})),
    m AS (SELECT s.*, f.v AS fv, b.v AS bv FROM stops s ASOF LEFT JOIN voiced f ON f.clip_id = s.clip_id AND s.t <= f.v ASOF LEFT JOIN voiced b ON b.clip_id = s.clip_id AND s.t - {A.STOP_LEAD_US} >= b.v),
    vot AS (SELECT clip_id, stop_id, phoneme, aspiration_class, t, CASE WHEN fv <= t + {w} THEN fv END AS forward_us, CASE WHEN bv >= t - {A.STOP_LEAD_US} - {w} THEN bv END AS backward_us FROM m),
    x AS (SELECT *, CASE WHEN aspiration_class = 'voiced' AND backward_us IS NOT NULL THEN (backward_us - t) / 1000.0 WHEN (forward_us - t) / 1000.0 BETWEEN -200 AND {w / 1000} THEN (forward_us - t) / 1000.0 END AS vot_ms FROM vot)"""


def _frames() -> str:
    return f"""lg AS (SELECT vec_id // {A.FRAMES_PER_CLIP} AS clip_id, CAST(vec_id % {A.FRAMES_PER_CLIP} AS INTEGER) AS frame_idx, list_transform(list_slice(embedding, 1, {A.LOGITS}), lambda x: CAST(x AS DOUBLE) * {A.SCALE}) AS z FROM embeddings WHERE embedding IS NOT NULL),
    fr AS (SELECT clip_id, frame_idx, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) AS lp FROM lg),
    cell AS (SELECT clip_id, frame_idx, unnest(range(0, {A.LOGITS})) AS v, unnest(lp) AS x FROM fr)"""


def _spans() -> str:
    return f"""WITH {_frames()}, sp AS (SELECT vec_id // {A.FRAMES_PER_CLIP} AS clip_id, CAST(vec_id % {A.FRAMES_PER_CLIP} AS INTEGER) // 5 AS span, CAST(label % {A.LOGITS - 1} + 1 AS INTEGER) AS target FROM embeddings WHERE vec_id % 5 = 0),
    me AS (SELECT sp.clip_id, sp.span, sp.target, v, avg(x) AS m FROM sp JOIN cell ON cell.clip_id = sp.clip_id AND cell.frame_idx // 5 = sp.span GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, span ORDER BY m DESC, v) AS place FROM me),
    pos AS (SELECT clip_id, span, target, max(m) FILTER (v = target) AS avg_log_prob, max(v) FILTER (place = 1) AS top1, coalesce(bool_or(place <= 3 AND v = target AND exp(m) >= {R.NEAR_MISS_MIN_PROB}), false) AS near FROM rk GROUP BY ALL),
    cl AS (SELECT *, CASE WHEN top1 = target AND avg_log_prob >= {R.PRODUCED_MIN_LOG_PROB} THEN 'produced' WHEN near THEN 'near_miss' ELSE 'absent' END AS match FROM pos)"""


def _runs(source: str, value: str) -> str:
    return f"""st AS (SELECT *, CASE WHEN {value} IS NOT DISTINCT FROM lag({value}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
    ru AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM st),
    rr AS (SELECT clip_id, run, {value}, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame FROM ru GROUP BY ALL)"""


def _levels() -> str:
    return """WITH s AS (SELECT l_orderkey AS clip_id, l_discount * 10 AS x0, l_quantity > 10 AS voiced FROM lineitem), p AS (SELECT clip_id, max(abs(x0)) AS peak FROM s GROUP BY ALL),
    n AS (SELECT s.clip_id, peak, voiced, CASE WHEN peak > 1 THEN x0 / peak ELSE x0 END AS x FROM s JOIN p USING (clip_id)),
    g AS (SELECT clip_id, max(peak) AS peak, avg(CASE WHEN abs(x) >= 0.99 THEN 1.0 ELSE 0.0 END) * 100 AS clip, sqrt(avg(x * x) FILTER (voiced)) AS sig, sqrt(avg(x * x) FILTER (NOT voiced)) AS noi, count(*) * 0.1 AS dur, avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END) AS vf FROM n GROUP BY ALL)"""


def _drift() -> str:
    symbols = values([(n.symbol, n.ipa) for n in R.alphabet()], "a(symbol, ipa)")
    equal = values([(ipa, other) for ipa, others in R.EQUIVALENCES.items() for other in others], "e(ipa, other)")
    return f"""WITH {_counts()}, al AS (SELECT * FROM {symbols}),
    fo AS (SELECT symbol, ipa AS form FROM al UNION SELECT symbol, other FROM al JOIN {equal} USING (ipa)
           UNION SELECT symbol, substr(ipa, 1, 1) || chr(865) || substr(ipa, 2) FROM al WHERE substr(ipa, 1, 2) IN ({", ".join(map(text, R.AFFRICATES))})),
    i AS (SELECT form AS ipa, string_agg(symbol, ', ' ORDER BY symbol) AS matches, bool_or(symbol = form) AS direct FROM fo GROUP BY form),
    t AS (SELECT DISTINCT lang AS language, '/' || symbol || '/' AS token FROM counts),
    d AS (SELECT t.*, i.matches, CASE WHEN i.matches IS NULL THEN 'phonological' WHEN i.direct THEN 'direct' ELSE 'notation-only' END AS category FROM t LEFT JOIN i ON i.ipa = regexp_replace(token, '^/+|/+$', '', 'g'))"""


def _voiced() -> str:
    """Samples, intervals and the mask they give."""
    hop, half = A.AUDIO_HOP, A.AUDIO_FRAME // (2 * A.AUDIO_HOP)
    return f"""WITH au AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 1000.0 * CASE WHEN event_type IN ('view', 'error') THEN 0.001 ELSE 1.0 END AS x FROM events),
    hp AS (SELECT clip_id, i // {hop} AS t, sum(x * x) AS e FROM au GROUP BY ALL), ln AS (SELECT clip_id, count(*) AS samples FROM au GROUP BY ALL),
    fm AS (SELECT * FROM hp UNION ALL SELECT clip_id, samples // {hop}, 0 FROM ln WHERE samples % {hop} = 0),
    pw AS (SELECT clip_id, t AS frame_idx, greatest(sum(e) OVER (PARTITION BY clip_id ORDER BY t RANGE BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING) / {A.AUDIO_FRAME}, {R.SILENCE**2}) AS p FROM fm),
    ld AS (SELECT clip_id, frame_idx, 10 * log10(p) - 10 * log10(max(p) OVER (PARTITION BY clip_id)) > -{R.SNR_TOP_DB} AS loud FROM pw), {_runs("ld", "loud")},
    iv AS (SELECT clip_id, start_frame * {hop} AS start, least(end_frame * {hop}, samples) AS "end" FROM rr JOIN ln USING (clip_id) WHERE loud AND start_frame * {hop} < samples)"""


def _noted(signal: str, noise: str) -> str:
    return f"""round(CASE WHEN {signal} > 0 AND {noise} = 0 THEN 60.0 WHEN {signal} > 0 AND {noise} > 0 THEN least(20 * log10({signal} / {noise}), 60.0) END, 6) AS snr_db,
            CASE WHEN {signal} IS NULL THEN 'No voiced regions detected; SNR not estimable.' WHEN {noise} IS NULL THEN 'No silent regions detected; SNR not estimable.' WHEN {signal} = 0 THEN 'Signal energy is zero; SNR not estimable.' END AS snr_note"""


def _requests() -> str:
    kind = lambda path: f"json_type(j, '$.{path}')"
    def rule(path: str, required: bool, nullable: bool, allowed: tuple[str, ...]) -> str:
        wrong = f"{kind(path)} <> 'VARCHAR' OR json_extract_string(j, '$.{path}') NOT IN ({', '.join(map(text, allowed))})" if allowed else f"{kind(path)} <> 'VARCHAR'"
        return f"CASE WHEN {kind(path)} IS NULL THEN {text(path + ': missing') if required else 'NULL'} {f'WHEN {kind(path)} = {text("NULL")} THEN NULL' if nullable else ''} WHEN {wrong} THEN {text(path + (': literal_error' if allowed else ': string_type'))} END"
    faults = [rule(f.path, f.required, f.nullable, f.allowed) for f in Q.FIELDS]
    for name, fields in Q.NESTED.items():
        faults.append(f"CASE WHEN {kind(name)} NOT IN ('NULL', 'OBJECT') THEN {text(name + ': model_type')} END")
        faults += [f"CASE WHEN {kind(name)} = 'OBJECT' THEN {rule(f'{name}.{f.path}', f.required, f.nullable, f.allowed)} END" for f in fields]
    whole = """'{"audio_base64": "UklGRg==", "format": "wav", "clip_purpose": "counting", "transcript": ' || CAST(json_object('format', 'ipa', 'content', coalesce(text, '')) AS VARCHAR) || '}'"""
    texts = {1: '{"audio_base64": ""}', 3: '{"format": "wav"}', 4: '{"audio_base64": "AA==", "clip_purpose": "ad-hoc-monologue"}', 5: '{"audio_base64": "AA==", "transcript": {"format": 5}}', 6: '{"audio_base64": "AA==", "transcript": "plain words"}', 7: '{"audio_base64": null, "format": null}', 8: "[1, 2]", 10: '{"audio_base64": "AA==", "claimed_language": "English", "clip_purpose": null, "transcript": null, "other": [1]}', 11: '{"audio_base64": "AA==", "expected_language": 7, "clip_purpose": true}'}
    cases = " ".join(f"WHEN {k} THEN {text(t)}" for k, t in texts.items())
    return f"""WITH q AS (SELECT conv_id, turn, CASE (conv_id * 8 + turn) % 12 WHEN 0 THEN {whole} WHEN 2 THEN left({whole}, length({whole}) // 2) {cases} END AS request FROM conversations),
    o AS (SELECT conv_id, turn, CASE WHEN request IS NOT NULL AND json_valid(request) THEN CAST(request AS JSON) END AS j FROM q),
    r AS (SELECT *, CASE WHEN j IS NULL THEN ['request: json_invalid'] WHEN json_type(j) <> 'OBJECT' THEN ['request: model_type'] ELSE list_filter([{", ".join(faults)}], lambda x: x IS NOT NULL) END AS reasons FROM o)
    SELECT conv_id, turn, len(reasons) = 0 AS accepted, array_to_string(reasons, ' | ') AS reasons, CASE WHEN len(reasons) = 0 THEN coalesce(json_extract_string(j, '$.format'), '{Q.DEFAULT_FORMAT}') END AS format, CASE WHEN len(reasons) = 0 THEN json_extract_string(j, '$.clip_purpose') END AS clip_purpose,
        CASE WHEN len(reasons) = 0 THEN json_extract_string(j, '$.claimed_language') END AS claimed_language, CASE WHEN len(reasons) = 0 THEN CAST(length(json_extract_string(j, '$.transcript.content')) AS INTEGER) END AS content_chars FROM r"""


def _grid() -> str:
    us, values_of = int(A.CLIP_STEP_S * 1e6), {"f1": "event_type = 'click'", "f2": "event_type IN ('view', 'click')", "f3": "event_type IN ('purchase', 'error', 'signup')"}
    parts = [f"""WITH tr AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * {us} AS t, event_type, value FROM events),
    gr AS (SELECT clip_id, CAST(unnest(range(0, n)) AS INTEGER) AS t_idx, unnest(range(0, n)) * {A.GRID_STEP_US} AS t FROM (SELECT clip_id, (max(t) + {us} + {A.GRID_STEP_US - 1}) // {A.GRID_STEP_US} AS n FROM tr GROUP BY ALL))"""]
    for c, rule in values_of.items():
        parts.append(f"""p{c} AS (SELECT clip_id, t, value AS v FROM tr WHERE {rule}), g{c} AS (SELECT g.clip_id, g.t_idx, CASE WHEN b.t = a.t THEN a.v WHEN b.t - a.t <= {A.GRID_GAP_US} THEN a.v + (b.v - a.v) * (g.t - a.t) / (b.t - a.t) END AS {c}
        FROM gr g ASOF LEFT JOIN p{c} a ON a.clip_id = g.clip_id AND g.t >= a.t ASOF LEFT JOIN p{c} b ON b.clip_id = g.clip_id AND g.t <= b.t)""")
    return ", ".join(parts) + ", gd AS (SELECT clip_id, t_idx, f1, f2, f3 FROM gf1 JOIN gf2 USING (clip_id, t_idx) JOIN gf3 USING (clip_id, t_idx))"


def _block_errors() -> str:
    noise = "sqrt(avg(x * x) FILTER (NOT voiced))"
    return f"""{_vot()}, sa AS (SELECT user_id AS clip_id, event_type <> 'error' AS voiced, value, CASE WHEN event_id % 499 = 5 THEN 'ValueError' WHEN event_id % 701 = 7 THEN 'FloatingPointError' END AS bad FROM events),
    pk AS (SELECT clip_id, min(bad) AS bad, max(abs(value)) AS peak FROM sa GROUP BY ALL),
    lv AS (SELECT clip_id, avg(CASE WHEN abs(x) >= {R.CLIPPING_AT} THEN 1.0 ELSE 0.0 END) * 100 AS clip, sqrt(avg(x * x) FILTER (voiced)) AS sig, {noise} AS noi FROM (SELECT sa.clip_id, voiced, CASE WHEN peak > 1 THEN value / peak ELSE value END AS x FROM sa JOIN pk USING (clip_id) WHERE pk.bad IS NULL) GROUP BY ALL),
    tk AS (SELECT user_id AS clip_id, max(CASE WHEN event_id % 557 = 2 THEN 'KeyError' END) AS bad, count(*) AS n FROM events GROUP BY ALL),
    vb AS (SELECT clip_id, max(CASE WHEN stop_id % 397 = 3 THEN 'ValueError' END) AS bad, count(vot_ms) AS n, avg(vot_ms) FILTER (aspiration_class = 'voiced') AS m FROM x GROUP BY ALL)
    SELECT tk.clip_id, {_noted("sig", "noi").split(",\n")[0]}, round(clip, 6) AS clipping_pct, CASE WHEN tk.bad IS NULL THEN tk.n END AS total_tokens, CASE WHEN vb.bad IS NULL THEN vb.n END AS n_measured, CASE WHEN vb.bad IS NULL THEN round(vb.m, 6) END AS voiced_mean_ms,
        concat_ws(' | ', 'quality measurement unavailable: ' || pk.bad, 'phoneme detection unavailable: ' || tk.bad, 'VOT estimation unavailable: ' || vb.bad) AS notes
    FROM tk JOIN pk USING (clip_id) LEFT JOIN lv USING (clip_id) LEFT JOIN vb USING (clip_id)"""


def _tokens() -> str:
    """Transcripts, their symbols and what the vocabulary has for each."""
    vocab = values(list(A.vocab().items()), "v(symbol, idx)")
    return f"""{_drift()}, ft AS (SELECT form, arg_min(al.ipa, al.symbol) AS ipa, min(al.symbol) AS ascii FROM fo JOIN al USING (symbol) GROUP BY form), vo AS (SELECT * FROM {vocab}),
    tt AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 = 5 THEN 'x-sampa' WHEN conv_id % 3 = 0 THEN 'espeak' WHEN turn % 2 = 1 THEN ' IPA ' ELSE 'ipa' END AS format, CASE WHEN (conv_id * 8 + turn) % 17 = 13 THEN ' ' ELSE lower(text) END AS content FROM conversations WHERE text IS NOT NULL),
    sy AS (SELECT conv_id, turn, CASE lower(trim(format)) WHEN 'ipa' THEN regexp_extract_all(translate(nfc_normalize(content), '/.ˈˌ', '  '), '{tokens.SYMBOL.replace("p{M}", "pM")}') WHEN 'espeak' THEN list_filter(string_split_regex(content, '\\s+'), lambda s: s <> '') ELSE [] END AS l FROM tt),
    ps AS (SELECT conv_id, turn, CAST(unnest(range(0, len(l))) AS INTEGER) AS position, unnest(l) AS symbol FROM sy),
    tm AS (SELECT conv_id, turn, position, ps.symbol, CASE WHEN d.idx IS NOT NULL THEN nfc_normalize(ps.symbol) WHEN o.idx IS NOT NULL THEN ft.ipa END AS phoneme, CAST(coalesce(d.idx, o.idx) AS INTEGER) AS vocab_idx
        FROM ps LEFT JOIN vo d ON d.symbol = nfc_normalize(ps.symbol) LEFT JOIN ft ON ft.form = nfc_normalize(ps.symbol) LEFT JOIN vo o ON o.symbol = ft.ascii WHERE ps.symbol NOT IN ({", ".join(map(text, R.NON_PHONEMES))}))"""


def _descriptions() -> str:
    ipa = "symbol"
    for n in sorted(R.NOTATION, key=lambda n: -len(n.symbol)):
        ipa = f"replace({ipa}, {text(n.symbol)}, {text(n.ipa)})"
    ends = "[" + ", ".join(map(text, A.SYMBOL_ENDS)) + "]"
    noted = lambda column: f"CASE WHEN len({column}) > 0 THEN '(' || array_to_string({column}, ', ') || ')' END"
    quoted = """CASE WHEN contains(ipa, '''') AND NOT contains(ipa, '"') THEN '"' || ipa || '"' ELSE '''' || ipa || '''' END"""
    return f"""WITH {_counts()}, b AS (SELECT DISTINCT symbol FROM counts), s AS (SELECT DISTINCT symbol || e AS symbol FROM b, (SELECT unnest({ends}) AS e)),
    i AS (SELECT symbol, coalesce({pick({n.symbol: n.ipa for n in R.NOTATION})}[symbol], replace({ipa}, ':', 'ː')) AS ipa FROM s),
    t AS (SELECT *, regexp_extract(ipa, '([{"".join(R.TONES)}]*)$', 1) AS tone FROM i), d AS (SELECT *, left(ipa, length(ipa) - length(tone)) AS body FROM t),
    g AS (SELECT *, nfc_normalize(regexp_replace(body, '[{"".join(R.MARKS)}͡]', '', 'g')) AS bare FROM d),
    p AS (SELECT *, regexp_extract_all(bare, '(?s).') AS l, list_filter(list_transform(regexp_extract_all(tone, '.'), lambda c: {pick(R.TONES)}[c]), lambda x: x IS NOT NULL) AS tones,
        list_filter(list_transform(regexp_extract_all(body, '(?s).'), lambda c: {pick(R.MARKS)}[c]), lambda x: x IS NOT NULL) AS ms FROM g),
    q AS (SELECT *, list_filter(ms, lambda x, k: list_position(ms, x) = k) AS marks, list_transform(l, lambda c: {pick(R.GLYPHS)}[c]) AS names FROM p)
    SELECT symbol, ipa, concat_ws(' ', CASE WHEN ipa IN ({", ".join(map(text, R.AFFRICATES))}) THEN 'Affricate' WHEN len(l) >= 2 AND len(list_filter(names, lambda x: coalesce(suffix(x, 'vowel'), false))) = len(l) THEN 'Diphthong/triphthong (' || array_to_string(l, ' + ') || ')'
        WHEN names[1] IS NOT NULL THEN array_to_string(list_prepend(names[1], list_filter(l[2:], lambda c: {pick(R.GLYPHS)}[c] IS NOT NULL)), ' + ')
        ELSE coalesce({pick(R.ODD_SYMBOLS)}[symbol], 'Uncategorised symbol (' || {quoted} || ')') END, {noted("marks")}, {noted("tones")}) AS description FROM q"""


def _forced() -> str:
    """The best path by recursion over frames, then back from the last one; its runs are the positions."""
    ninf = "CAST('-inf' AS DOUBLE)"
    step = lambda k: f"CASE WHEN s > {k} THEN sc[s - {k}] ELSE {ninf} END"
    per_frame = f"({A.FRAMES_PER_CLIP * A.FRAME_S} * 1000.0 / n)"
    return f"""WITH RECURSIVE {_frames()}, tg AS (SELECT vec_id // {A.FRAMES_PER_CLIP} AS clip_id, list(CAST(label % {A.LOGITS - 1} + 1 AS INTEGER) ORDER BY vec_id) AS want FROM embeddings WHERE vec_id % 5 = 0 GROUP BY ALL),
    cl AS (SELECT clip_id, list(lp ORDER BY frame_idx) AS lps, list(frame_idx ORDER BY frame_idx) AS fi, count(*) AS n FROM fr GROUP BY clip_id),
    st AS (SELECT clip_id, lps, fi, n, want, 2 * len(want) + 1 AS m, list_transform(range(1, 2 * len(want) + 2), lambda s: CASE WHEN s % 2 = 0 THEN want[s // 2] ELSE 0 END) AS ids FROM cl JOIN tg USING (clip_id)
        WHERE len(want) + len(list_filter(range(2, len(want) + 1), lambda i: want[i] = want[i - 1])) <= n),
    vi AS (SELECT clip_id, 1 AS t, list_transform(ids, lambda x, s: CASE WHEN s <= 2 THEN lps[1][x + 1] ELSE {ninf} END) AS sc, [CAST([] AS INTEGER[])] AS bk FROM st
        UNION ALL SELECT clip_id, t + 1, list_transform(nx, lambda x, s: x[1] + lps[t + 1][ids[s] + 1]), list_append(bk, list_transform(nx, lambda x: CAST(x[2] AS INTEGER)))
        FROM (SELECT clip_id, t, bk, st.lps, st.ids, list_transform(tr, lambda x: [greatest(x[1], x[2], x[3]), CASE WHEN x[1] = greatest(x[1], x[2], x[3]) THEN 0 WHEN x[2] = greatest(x[1], x[2], x[3]) THEN 1 ELSE 2 END]) AS nx
            FROM (SELECT vi.*, list_transform(range(1, st.m + 1), lambda s: [sc[s], {step(1)}, CASE WHEN s % 2 = 0 AND s > 2 AND ids[s] <> ids[s - 2] THEN sc[s - 2] ELSE {ninf} END]) AS tr FROM vi JOIN st USING (clip_id) WHERE t < n) JOIN st USING (clip_id))),
    en AS (SELECT vi.clip_id, n, bk, CASE WHEN sc[m] >= sc[m - 1] THEN m ELSE m - 1 END AS s FROM vi JOIN st USING (clip_id) WHERE t = n),
    bp AS (SELECT clip_id, n AS t, s FROM en UNION ALL SELECT clip_id, t - 1, s - back FROM (SELECT bp.clip_id, t, bp.s, en.bk[t][bp.s] AS back FROM bp JOIN en USING (clip_id)) WHERE t > 1),
    pa AS (SELECT bp.clip_id, fi[t] AS frame_idx, ids[s] AS token, lps[t] AS lp FROM bp JOIN st USING (clip_id)),
    sw AS (SELECT *, CASE WHEN token IS NOT DISTINCT FROM lag(token) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM pa WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
    rw AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM sw),
    sp AS (SELECT clip_id, run, row_number() OVER (PARTITION BY clip_id ORDER BY run) - 1 AS span, min(frame_idx) AS a, max(frame_idx) + 1 AS b FROM rw WHERE token <> 0 GROUP BY clip_id, run),
    ce AS (SELECT rw.clip_id, span, a, b, unnest(range(0, {A.LOGITS})) AS v, unnest(lp) AS x FROM rw JOIN sp USING (clip_id, run)),
    me AS (SELECT clip_id, span, a, b, v, avg(x) AS m FROM ce GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, span ORDER BY m DESC, v) AS place FROM me),
    ps AS (SELECT rk.clip_id, span, a, b, want[span + 1] AS target, max(m) FILTER (v = want[span + 1]) AS lp, max(v) FILTER (place = 1) AS top1, coalesce(bool_or(place <= 3 AND v = want[span + 1] AND exp(m) >= {R.NEAR_MISS_MIN_PROB}), false) AS near, max(n) AS n FROM (SELECT rk.*, want, n FROM rk JOIN st USING (clip_id)) rk GROUP BY rk.clip_id, span, a, b, want)
    SELECT clip_id, CAST(span AS INTEGER) AS span, target, CAST(round_even(a * {per_frame}, 0) AS BIGINT) AS start_ms, CAST(round_even(b * {per_frame}, 0) AS BIGINT) AS end_ms, round(lp, 6) AS avg_log_prob, CAST(top1 AS INTEGER) AS top1,
        CASE WHEN top1 = target AND lp >= {R.PRODUCED_MIN_LOG_PROB} THEN 'produced' WHEN near THEN 'near_miss' ELSE 'absent' END AS match FROM ps"""


def _printed(sql: dict[str, str]) -> str:
    probe = f"printf('      %s  /%s/  %s: count=%d, expected=%d, approximate_seen=%d', {pick(R.STATUS_MARKS)}[status], ipa, label, count, s.expected_count, approximate_count)"
    ipas = values([(p.language, p.label, p.ipa) for p in R.PROBES], "p(probe_set, label, ipa)")
    return f"""WITH s AS (SELECT s.*, p.ipa FROM ({sql["stretch_scores"]}) s JOIN (SELECT * FROM {ipas}) p USING (probe_set, label)),
    g AS (SELECT clip_id, printf('  stretch_phonemes (%s):', max(probe_set)) || chr(10) || string_agg({probe}, chr(10) ORDER BY ord) AS lines FROM s GROUP BY clip_id),
    t AS (SELECT clip_id, CAST(sum(n) AS BIGINT) AS n FROM ({sql["symbol_counts"]}) GROUP BY ALL)
    SELECT m.clip_id, concat_ws(chr(10), printf('  phoneme_tokens=%d', t.n), printf('  language_match  %s  verdict=%s  score=%s', {pick(R.VERDICT_MARKS)}[verdict], verdict, coalesce(printf('%.2f', score), 'n/a')),
        printf('                  positives: %d/%d markers found', positive_hits, positive_total), printf('                  negatives: %d/%d clean', negative_clean, negative_total),
        CASE WHEN notes <> '' THEN '                  - ' || replace(notes, ' | ', chr(10) || '                  - ') END, g.lines, CASE WHEN m.clip_id % 4 = 3 THEN '  note: no stretch probe set for language=''klingon''' END) AS text
    FROM ({sql["language_match_claimed"]}) m JOIN ({sql["language_match_notes"]}) n USING (clip_id) JOIN t USING (clip_id) LEFT JOIN g ON g.clip_id = m.clip_id"""


def oracle_sql() -> dict[str, str]:
    sql = _single()
    sql["match_summary"] = _printed(sql)
    sql |= {"sql_smooth_counts": sql["smoothed_counts"], "sql_language_match": sql["language_match_claimed"], "symbol_descriptions": _descriptions(), "forced_alignment": _forced()}
    sql["baseline_window"] = _baseline(sql)
    return sql | {"analyze_response": _response(sql)}


def _baseline(sql: dict[str, str]) -> str:
    """Other queries over the first five seconds of each user's events."""
    frames = int(R.BASELINE_S / A.CLIP_STEP_S)
    first = f"FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {frames})"
    f0, rate = (sql[name].replace("FROM events", first) for name in ("f0_stats", "syllable_rate"))
    return f"""SELECT clip_id, CASE WHEN clip_id % 2 = 0 THEN 'diagnostic' ELSE 'unspecified' END AS source_clip, 0 AS window_start_ms, {int(R.BASELINE_S * 1000)} AS window_end_ms, mean_hz AS f0_mean_hz, std_semitones AS f0_std_semitones, rate_hz AS syllable_rate_hz,
        'First 5s of clip used as baseline; values for normalisation only.' AS notes
        FROM (SELECT user_id AS clip_id, count(*) AS n FROM events GROUP BY ALL) LEFT JOIN ({f0}) USING (clip_id) LEFT JOIN ({rate.replace("* 0.01", f"* {A.CLIP_STEP_S}")}) USING (clip_id) WHERE n >= {frames}"""


def _response(sql: dict[str, str]) -> str:
    """The blocks of a response side by side, each from the query that gives it alone."""
    blocks = {
        "language_match": (sql["language_match_claimed"], "profile verdict score positive_hits positive_total negative_clean negative_total"),
        "f0": (sql["f0_stats"], "mean_hz min_hz max_hz std_hz std_semitones range_semitones_p10_p90 voiced_fraction"),
        "formants": (sql["formant_means"], "f1_mean_hz f2_mean_hz f3_mean_hz"),
        "syllables": (sql["syllable_rate"].replace("* 0.01", f"* {A.CLIP_STEP_S}"), "peaks accepted rate_hz"),
        "vot": (sql["vot_class_means"], "n_measured aspirated_voiceless_mean_ms plain_voiceless_mean_ms voiced_mean_ms"),
        "quality": (f"SELECT * FROM ({sql['snr_rms']}) JOIN ({sql['clipping_pct']}) USING (clip_id)", "signal_rms noise_rms snr_db snr_note peak clipping_pct"),
        "baseline": (sql["baseline_window"], "source_clip window_start_ms window_end_ms f0_mean_hz f0_std_semitones syllable_rate_hz notes"),
        "aligned_phonemes": (sql["alignment_quality"], "alignment_quality mean_log_prob"),
    }
    state = ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS INTEGER) AS stretch_{s}" for s in ("hit", "approximate", "missed"))
    sums = {
        "ln": f"SELECT clip_id, notes AS language_match_notes FROM ({sql['language_match_notes']})",
        "st": f"SELECT clip_id, max(probe_set) AS stretch_probe_set, {state} FROM ({sql['stretch_scores']}) GROUP BY ALL",
        "sy": f"SELECT clip_id, CAST(sum(n) AS BIGINT) AS phonemes_total_tokens, CAST(count(*) AS INTEGER) AS phonemes_symbols FROM ({sql['symbol_counts']}) GROUP BY ALL",
        "sm": f"SELECT clip_id, round(sum(smoothed), 6) AS phonemes_smoothed FROM ({sql['smoothed_counts']}) GROUP BY ALL",
        "ev": f"SELECT clip_id, CAST(count(*) AS INTEGER) AS phonemes_targets FROM ({sql['confusion_interpretation']}) GROUP BY ALL",
        "po": f"SELECT clip_id, CAST(count(*) AS INTEGER) AS aligned_positions, CAST(count(*) FILTER (match = 'produced') AS INTEGER) AS aligned_produced FROM ({sql['span_classification']}) GROUP BY ALL",
        "ps": f"SELECT clip_id, CAST(count(*) FILTER (evidence_strength = 'strong') AS INTEGER) AS aligned_strong FROM ({sql['phoneme_summary']}) GROUP BY ALL",
    }
    fields = ", ".join(f"{b}.{f} AS {b}_{f}" for b, (_, names) in blocks.items() for f in names.split())
    own = "ln.language_match_notes, st.stretch_probe_set, st.stretch_hit, st.stretch_approximate, st.stretch_missed, sy.phonemes_total_tokens, sy.phonemes_symbols, sm.phonemes_smoothed, coalesce(ev.phonemes_targets, CASE WHEN sy.clip_id IS NOT NULL THEN 0 END) AS phonemes_targets, po.aligned_positions, po.aligned_produced, ps.aligned_strong"
    joins = " ".join(f"LEFT JOIN ({query}) {b} ON {b}.clip_id = d.doc_id" for b, query in ({b: q for b, (q, _) in blocks.items()} | sums).items())
    notes = "concat_ws(' | ', CASE WHEN n_chars / 15.0 < 0.3 THEN 'clip is very short (<0.3s); results may be unreliable' END, CASE WHEN f0.voiced_fraction < 0.05 THEN 'very little voiced audio detected; pitch may be unreliable' END, CASE WHEN d.doc_id % 4 = 3 AND sy.clip_id IS NOT NULL THEN 'no stretch probe set for language=''klingon''' END)"
    return f"SELECT d.doc_id AS clip_id, round(n_chars / 15.0, 6) AS duration_s, {fields}, {own}, {notes} AS notes FROM documents d {joins}"


def _single() -> dict[str, str]:
    claimed = "SELECT clip_id, total, profile FROM inv JOIN names ON names.name = inv.lang"
    every = "SELECT clip_id, total, profile FROM inv, (SELECT DISTINCT profile FROM names)"
    claims = "[" + ", ".join(map(text, A.CLAIMS)) + "]"
    purposes = "[" + ", ".join(map(text, A.PURPOSES)) + ", NULL]"
    probes = [(p.language, i, p.label, p.expected) for i, p in R.by_language(R.PROBES)]
    parts = [(p.language, i, kind, v) for i, p in R.by_language(R.PROBES) for kind, vs in (("accept", p.accepted), ("near", p.approximate)) for v in vs]
    vocab = "[" + ", ".join(map(text, A.VOCAB)) + "]"
    st, hz = ("st_class", "hz_class")
    cross = ", ".join(f"count(*) FILTER ({c} = '{k}') AS {c[:2]}_{k}" for c in (hz, st) for k in ("flat", "moderate", "expressive"))
    pct = lambda g, k: f"coalesce(count(*) FILTER (leaning = '{g}' AND st_class = '{k}') * 100.0 / nullif(count(*) FILTER (leaning = '{g}'), 0), 0)"
    file_buckets = values([(f"{e}-{i}", name) for e, i, name in R.BUCKETS], "b(k, bucket)")
    two = lambda e: f"lpad(CAST(o_orderkey % {e} + 1 AS VARCHAR), 2, '0')"
    return {
        "symbol_counts": f"WITH {_counts()} SELECT clip_id, symbol, n FROM counts",
        "language_match_claimed": f"{_match(claimed)} {_SCORED}",
        "language_match_all_profiles": f"{_match(every)} {_SCORED}",
        "language_match_notes": f"""{_match(claimed)}, lab AS (SELECT clip_id, list_slice(list(label ORDER BY ord) FILTER (side = 'positive' AND NOT passed AND NOT optional), 1, 5) AS la, list_slice(list(label ORDER BY ord) FILTER (side = 'negative' AND NOT passed), 1, 5) AS lb FROM judged GROUP BY clip_id)
            SELECT clip_id, CASE WHEN s IS NULL THEN 'clip has ' || total || ' phoneme tokens; need ≥{R.MIN_TOKENS} to score' ELSE
            concat_ws(' | ', CASE WHEN len(la) > 0 THEN 'expected but missing: ' || array_to_string(la, ', ') END, CASE WHEN len(lb) > 0 THEN 'present but unexpected: ' || array_to_string(lb, ', ') END) END AS notes FROM scored JOIN lab USING (clip_id)""",
        "resolve_profile": f"""WITH {_markers()}, c AS (SELECT c_custkey, {claims}[c_custkey % {len(A.CLAIMS)} + 1] AS claim FROM customer),
            k AS (SELECT *, lower(trim(claim)) AS key, list_filter(string_split(translate(lower(trim(claim)), '-_', '  '), ' '), lambda w: w <> '') AS w FROM c)
            SELECT c_custkey, claim, CASE WHEN claim <> '' THEN coalesce((SELECT profile FROM names WHERE name = key), (SELECT profile FROM names WHERE contains(key, '(') AND name = trim(string_split(key, '(')[1])),
            (SELECT profile FROM names WHERE name = w[1]), (SELECT profile FROM names WHERE name = w[-1])) END AS profile FROM k""",
        "stretch_scores": f"""WITH {_counts()}, pr AS (SELECT * FROM {values(probes, "p(probe_set, ord, label, expected_count)")}), pa AS (SELECT * FROM {values(parts, "q(probe_set, ord, kind, variant)")}),
            a AS (SELECT clip_id, CASE clip_id % 4 WHEN 0 THEN 'arabic' WHEN 1 THEN 'mandarin' WHEN 2 THEN 'arabic' END AS probe_set FROM inv),
            h AS (SELECT a.clip_id, pa.ord, sum(n) FILTER (kind = 'accept') AS n, sum(n) FILTER (kind = 'near') AS m FROM a JOIN pa USING (probe_set) JOIN counts c ON c.clip_id = a.clip_id AND c.symbol = pa.variant GROUP BY ALL),
            r AS (SELECT a.clip_id, probe_set, pr.ord, label, expected_count, CAST(coalesce(n, 0) AS BIGINT) AS count, CAST(coalesce(m, 0) AS BIGINT) AS approximate_count FROM a JOIN pr USING (probe_set) LEFT JOIN h ON h.clip_id = a.clip_id AND h.ord = pr.ord)
            SELECT *, CASE WHEN count >= expected_count THEN 'hit' WHEN count >= 1 OR approximate_count >= 1 THEN 'approximate' ELSE 'missed' END AS status FROM r""",
        "ipa_normalised_counts": f"{_ipa()} SELECT * FROM ipa",
        "smoothed_counts": f"{_ipa()} SELECT clip_id, symbol, round(sum(x), 6) AS smoothed FROM (SELECT clip_id, symbol, CAST(n AS DOUBLE) AS x FROM ipa UNION ALL SELECT clip_id, target, contribution FROM ev) GROUP BY ALL",
        "confusion_evidence": f"{_ipa()} SELECT clip_id, target, ord, from_symbol, raw_count, round(weight, 6) AS weight, round(contribution, 6) AS contribution FROM ev",
        "confusion_interpretation": f"""{_ipa()}, t AS (SELECT clip_id, target, sum(contribution) AS add, list(from_symbol ORDER BY ord) AS src FROM ev GROUP BY ALL), d AS (SELECT clip_id, symbol AS target, n FROM ipa WHERE symbol IN (SELECT target FROM near)),
            j AS (SELECT coalesce(t.clip_id, d.clip_id) AS clip_id, coalesce(t.target, d.target) AS target, coalesce(n, 0) AS raw_count, coalesce(n, 0) + coalesce(add, 0.0) AS s, coalesce(src, []) AS src FROM t FULL JOIN d ON t.clip_id = d.clip_id AND t.target = d.target)
            SELECT clip_id, target, raw_count, round(s, 6) AS smoothed_count, CAST(len(src) AS INTEGER) AS n_sources, CASE WHEN len(src) = 0 THEN printf('Direct detection: %d. No additional smoothed evidence.', raw_count)
            WHEN raw_count = 0 THEN printf('Direct detection: 0. Smoothed evidence: %.2f (from %s). Speaker may produce /%s/ that the model misclassifies.', s, array_to_string(src, ', '), target)
            ELSE printf('Direct detection: %d. Smoothed evidence: %.2f (direct + contributions from %s).', raw_count, s, array_to_string(src, ', ')) END AS interpretation FROM j""",
        "inventory_status": f"WITH {_counts()} SELECT clip_id, u.symbol, CASE WHEN n >= 2 THEN 'present' WHEN n = 1 THEN 'approximate' ELSE 'absent' END AS status FROM inv CROSS JOIN (SELECT unnest(['θ', 'ʃ', 'x', 'z', 'q', 'ɾ']) AS symbol) u LEFT JOIN counts USING (clip_id, symbol)",
        "f0_stats": f"WITH {_PITCH}, f AS ({_f0('clip_id')}) SELECT clip_id, {_five('mean_hz', 'mean_hz')}, {_five('min_hz', 'min_hz')}, {_five('max_hz', 'max_hz')}, {_five('std_hz', 'std_hz')}, {_five('std_st', 'std_semitones')}, {_five('r', 'range_semitones_p10_p90')}, round(vf, 6) AS voiced_fraction FROM f",
        "f0_semitone_spread": f"WITH {_PITCH}, f AS ({_f0('clip_id, event_type')}) SELECT clip_id, event_type, {_five('std_st', 'std_semitones')}, {_five('r', 'range_semitones_p10_p90')} FROM f",
        "formant_means": "SELECT user_id AS clip_id, round(avg(value) FILTER (event_type = 'click'), 6) AS f1_mean_hz, round(avg(value) FILTER (event_type IN ('view', 'click')), 6) AS f2_mean_hz, round(avg(value) FILTER (event_type = 'purchase'), 6) AS f3_mean_hz FROM events GROUP BY ALL",
        "syllable_peaks": """WITH e AS (SELECT user_id AS clip_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, value AS db, lag(value) OVER w AS a, lead(value) OVER w AS b, avg(value) OVER (PARTITION BY user_id) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
            SELECT clip_id, idx, round(db, 6) AS db FROM e WHERE db > a AND db > b AND db > m - 5""",
        "syllable_rate": """WITH RECURSIVE e AS (SELECT user_id AS clip_id, row_number() OVER w AS i, value AS db, lag(value) OVER w AS a, lead(value) OVER w AS b, avg(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            f AS (SELECT *, db > a AND db > b AND db > m - 5 IS TRUE AS peak FROM e),
            r AS (SELECT clip_id, i, n, 0 AS accepted, CAST(0 AS DOUBLE) AS last, CAST('inf' AS DOUBLE) AS low FROM f WHERE i = 1
                  UNION ALL SELECT f.clip_id, f.i, f.n, CASE WHEN k THEN accepted + 1 ELSE accepted END, CASE WHEN k THEN f.db ELSE last END, CASE WHEN k THEN f.db ELSE least(low, f.db) END
                  FROM (SELECT r.*, f.db, f.i AS fi, coalesce(f.peak, false) AND (accepted = 0 OR last - low >= 2) AS k FROM r JOIN f ON f.clip_id = r.clip_id AND f.i = r.i + 1) r JOIN f ON f.clip_id = r.clip_id AND f.i = r.fi),
            z AS (SELECT clip_id, count(*) FILTER (peak) AS peaks, max(n) AS n FROM f GROUP BY ALL)
            SELECT z.clip_id, CAST(peaks AS INTEGER) AS peaks, accepted, round(CASE WHEN z.n >= 10 THEN CASE WHEN peaks = 0 THEN 0.0 ELSE accepted / (z.n * 0.01) END END, 6) AS rate_hz FROM z JOIN r ON r.clip_id = z.clip_id AND r.i = z.n""",
        "vot_forward": f"{_vot()} SELECT clip_id, stop_id, round((forward_us - t) / 1000.0, 6) AS forward_ms FROM x",
        "vot_backward": f"{_vot()} SELECT clip_id, stop_id, round((backward_us - t) / 1000.0, 6) AS backward_ms FROM x",
        "vot_measurements": f"{_vot()} SELECT clip_id, stop_id, phoneme, aspiration_class, round(vot_ms, 6) AS vot_ms FROM x WHERE vot_ms IS NOT NULL",
        "vot_class_means": f"{_vot()} SELECT clip_id, count(vot_ms) AS n_measured, {', '.join(f'round(avg(vot_ms) FILTER (aspiration_class = {text(n)}), 6) AS {n}_mean_ms' for n in ('aspirated_voiceless', 'plain_voiceless', 'voiced'))} FROM x GROUP BY ALL",
        "frame_argmax": f"WITH {_frames()} SELECT clip_id, frame_idx, CAST(list_position(lp, list_max(lp)) - 1 AS INTEGER) AS token FROM fr",
        "frame_log_softmax": f"WITH {_frames()} SELECT clip_id, frame_idx, CAST(v AS INTEGER) AS v, round(x, 6) AS log_prob FROM cell",
        "frame_top3": f"WITH {_frames()} SELECT clip_id, frame_idx, CAST(place - 1 AS INTEGER) AS place, CAST(v AS INTEGER) AS idx, round(exp(x), 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY x DESC, v) AS place FROM cell) WHERE place <= 3",
        "ctc_occurrences": f"""WITH {_frames()}, ids AS (SELECT clip_id, frame_idx, CAST(list_position(lp, list_max(lp)) - 1 AS INTEGER) AS token FROM fr), {_runs("ids", "token")}, n AS (SELECT clip_id, count(*) AS n FROM fr GROUP BY ALL),
            o AS (SELECT rr.clip_id, row_number() OVER (PARTITION BY rr.clip_id ORDER BY run) AS seq, coalesce({vocab}[token + 1], '<vocab:' || token || '>') AS phoneme, start_frame * ({A.FRAMES_PER_CLIP * A.FRAME_S} / n) AS s, end_frame * ({A.FRAMES_PER_CLIP * A.FRAME_S} / n) AS e FROM rr JOIN n USING (clip_id) WHERE token <> 0)
            SELECT clip_id, CAST(seq AS INTEGER) AS seq, phoneme, round(s, 6) AS start_s, round(e, 6) AS end_s FROM o""",
        "event_type_runs": f"WITH ids AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_type FROM events), {_runs('ids', 'event_type')} SELECT clip_id, CAST(run AS BIGINT) AS run, event_type, CAST(start_frame AS INTEGER) AS start_frame, CAST(end_frame AS INTEGER) AS end_frame FROM rr",
        "span_classification": f"{_spans()} SELECT clip_id, span, target, round(avg_log_prob, 6) AS avg_log_prob, CAST(top1 AS INTEGER) AS top1, match FROM cl",
        "phoneme_summary": f"""{_spans()}, g AS (SELECT clip_id, target, count(*) AS expected, count(*) FILTER (match = 'produced') AS produced, count(*) FILTER (match = 'near_miss') AS near_miss, count(*) FILTER (match = 'absent') AS absent FROM cl GROUP BY ALL)
            SELECT *, CASE WHEN produced >= ceil(expected * {R.STRONG_RATIO}) THEN 'strong' WHEN produced + near_miss >= ceil(expected * {R.MODERATE_RATIO}) THEN 'moderate' ELSE 'weak' END AS evidence_strength FROM g""",
        "alignment_quality": f"{_spans()}, g AS (SELECT clip_id, avg(avg_log_prob) AS m FROM cl GROUP BY ALL) SELECT clip_id, round(m, 6) AS mean_log_prob, CASE WHEN m >= {R.HIGH_MIN_LOG_PROB} THEN 'high' WHEN m >= {R.MEDIUM_MIN_LOG_PROB} THEN 'medium' ELSE 'low' END AS alignment_quality FROM g",
        "clipping_pct": f"{_levels()} SELECT clip_id, round(peak, 6) AS peak, round(clip, 6) AS clipping_pct FROM g",
        "snr_rms": f"""{_levels()} SELECT clip_id, round(sig, 6) AS signal_rms, round(noi, 6) AS noise_rms, round(CASE WHEN sig > 0 AND noi = 0 THEN 60.0 WHEN sig > 0 AND noi > 0 THEN least(20 * log10(sig / noi), 60.0) END, 6) AS snr_db,
            CASE WHEN sig IS NULL THEN 'No voiced regions detected; SNR not estimable.' WHEN noi IS NULL THEN 'No silent regions detected; SNR not estimable.' WHEN sig = 0 THEN 'Signal energy is zero; SNR not estimable.' END AS snr_note FROM g""",
        "source_clip": f"SELECT c_custkey, CASE WHEN p IN ({', '.join(map(text, R.CLIP_PURPOSES))}) THEN p ELSE 'unspecified' END AS source_clip FROM (SELECT c_custkey, {purposes}[c_custkey % {len(A.PURPOSES) + 1} + 1] AS p FROM customer)",
        "stratified_sample_counts": f"{_features()} SELECT bucket, least(count(*), 60) AS n, CAST(least(count(*), 60) AS INTEGER) AS last_draw FROM clips GROUP BY ALL",
        "bucket_summary": _summary("bucket"),
        "gender_summary": _summary("leaning, gender"),
        "st_cutoffs": f"{_features()} SELECT lo AS low_cut, hi AS high_cut FROM cut",
        "reclassified": f"{_features()} SELECT clip_id, bucket, hz_class, st_class, hz_class <> st_class AND hz_class <> 'n/a' AND st_class <> 'n/a' AS changed FROM cls",
        "class_crosstab": f"{_features()} SELECT bucket, count(*) AS n, {cross} FROM cls GROUP BY ALL",
        "calibration_verdict": f"""{_features()}, v AS (SELECT {pct("flat-leaning", "flat")} AS a, {pct("expressive-leaning", "expressive")} AS b, {pct("flat-leaning", "expressive")} AS c, {pct("expressive-leaning", "flat")} AS d FROM cls)
            SELECT round(a, 6) AS flat_pct, round(b, 6) AS expressive_pct, round(c, 6) AS flat_cross_pct, round(d, 6) AS expressive_cross_pct, CASE WHEN a >= 40 AND b >= 40 AND c < 25 AND d < 25 THEN 'defensible' ELSE 'weak' END AS verdict FROM v""",
        "clip_file_fields": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN {two(8)} END AS emotion, CASE WHEN o_orderkey % 10 <> 0 THEN {two(24)} END AS actor, {two(2)} AS ch FROM orders)
            SELECT o_orderkey, emotion, actor, bucket, CASE WHEN emotion IS NOT NULL THEN {pick(R.INTENSITIES)}[ch] || ' ' || {pick(R.EMOTIONS)}[emotion] END AS spoken_as, CASE WHEN actor IS NOT NULL THEN CASE WHEN CAST(actor AS INTEGER) % 2 <> 0 THEN 'male' ELSE 'female' END END AS gender FROM o LEFT JOIN (SELECT * FROM {file_buckets}) b ON ch = '01' AND b.k = emotion || '-' || ch""",
        "tolerant_numbers": "WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS x FROM events) SELECT event_id, round(x, 6) AS x, coalesce(printf('%.2f', round(x, 1)), 'n/a') AS shown FROM v",
        "drift_summary": f"{_drift()} SELECT category, count(*) AS n FROM d GROUP BY ALL",
        "drift_detail": f"{_drift()} SELECT language, token, category, matches FROM d",
        "drift_gaps": f"{_drift()} SELECT token, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM d WHERE category = 'phonological' GROUP BY ALL",
        "quality_notes": f"""{_levels()} SELECT clip_id, concat_ws(' | ', CASE WHEN dur < 0.3 THEN 'clip is very short (<0.3s); results may be unreliable' END, CASE WHEN vf - 0.5 < 0.05 THEN 'very little voiced audio detected; pitch may be unreliable' END,
            CASE WHEN clip >= {R.CLIPPING_NOTE_PCT} THEN printf('Audio significantly affected by clipping (%.2f%%).', clip) END, CASE WHEN dur < {R.BASELINE_S} THEN 'Clip too short (<5s) for baseline calibration.' END) AS notes FROM g""",
        "f0_range": f"WITH {_PITCH}, f AS ({_f0('clip_id')}) SELECT clip_id, {_five('max_hz - min_hz', 'range_hz_max_min')} FROM f",
        "symbols_per_clip": f"WITH {_counts()} SELECT clip_id, string_agg(symbol, ' ' ORDER BY symbol) AS symbols, CAST(count(*) AS INTEGER) AS n_symbols FROM (SELECT DISTINCT clip_id, symbol FROM tok) GROUP BY ALL",
        "clip_runs": """WITH e AS (SELECT user_id, event_id, event_type AS value, epoch_us(ts) // 1000 AS t0 FROM events),
            f AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND t0 - lag(t0) OVER w <= 604800000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id)),
            g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS run FROM f)
            SELECT user_id, any_value(value) AS event_type, min(t0) AS first, max(t0) AS last, count(*) AS n FROM g GROUP BY user_id, run""",
        "voiced_intervals": f'{_voiced()} SELECT clip_id, start, "end" FROM iv',
        "snr_voiced": f"""{_voiced()}, mk AS (SELECT clip_id, x, EXISTS (SELECT 1 FROM iv WHERE iv.clip_id = au.clip_id AND au.i >= start AND au.i < "end") AS voiced FROM au),
            g AS (SELECT clip_id, sqrt(avg(x * x) FILTER (voiced)) AS sig, sqrt(avg(x * x) FILTER (NOT voiced)) AS noi, avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END) AS vf FROM mk GROUP BY ALL)
            SELECT clip_id, round(sig, 6) AS signal_rms, round(noi, 6) AS noise_rms, {_noted("sig", "noi")}, round(vf, 6) AS voiced_fraction FROM g""",
        "request_validation": _requests(),
        "formant_grid": f"{_grid()} SELECT clip_id, t_idx, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3 FROM gd",
        "formant_grid_means": f"{_grid()} SELECT clip_id, round(avg(f1), 6) AS f1_mean_hz, round(avg(f2), 6) AS f2_mean_hz, round(avg(f3), 6) AS f3_mean_hz FROM gd GROUP BY ALL",
        "response_block_errors": _block_errors(),
        "transcript_tokens": f"{_tokens()} SELECT conv_id, turn, position, symbol, phoneme, vocab_idx FROM tm",
        "alignment_warnings": f"""{_tokens()}, w AS (SELECT conv_id, turn, count(vocab_idx) AS n, string_agg(printf('Phoneme /%s/ at position %d has no model vocabulary mapping; alignment skipped for this position.', symbol, position), ' | ' ORDER BY position) FILTER (vocab_idx IS NULL) AS lost FROM tm GROUP BY ALL)
            SELECT conv_id, turn, coalesce(n, 0) AS n_tokens, concat_ws(' | ', CASE WHEN format = 'x-sampa' THEN 'Unknown transcript format ''x-sampa''; expected one of ipa, espeak, orthography_with_dictionary. Alignment skipped.' END, lost,
            CASE WHEN coalesce(n, 0) = 0 THEN 'Transcript produced no alignable tokens; alignment skipped.' WHEN n > turn * 40 THEN printf('Transcript (%d phonemes) is longer than the audio (%d frames); alignment skipped.', n, turn * 40) END) AS warnings FROM tt LEFT JOIN w USING (conv_id, turn)""",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    }
