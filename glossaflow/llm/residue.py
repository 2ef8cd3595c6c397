"""Template residue and error-page text: lines counted by host, recurrent boilerplate subtracted, the residual searched for evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as sre
from re import _parser as re_parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.session import spread

#: A line is boilerplate of its host if it recurs, that is, is in several documents, and at least this share of the host's documents have it.
SHARE = 0.02

_NOUN = r"(?:article|abstract|document|page|record|patent|full text|study entry|entry|paper|report|content|file|resource|text|item|site|link|url)"
_REASON = (
    r"(?:(?:page |file |resource )?not found|bad gateway|internal server error|server error|forbidden|gateway time-?out|request time-?out|request timed out|slow down|unauthori[sz]ed|"
    r"(?:service )?(?:temporarily )?unavailable|bad request|gone\b|too many requests|access denied|payment required|method not allowed|moved permanently|conflict)"
)
_JS = r"(?:java ?script|scripts?|scripting|cookies)"
#: Fixed values. Unfilled fields by their signs. Names have at least two letters, so that sets, concentrations and prices are none.
FIELDS = [
    r"\{\{\s*[a-z][\w. -]*\}\}", r"\{%\s*[a-z][\w. -]*%\}", r"[#$]?\{\s*[a-z][\w.]*[a-z0-9]\s*\}", r"<%=?\s*[a-z][\w. -]*%>", r"@@[a-z][\w.]*@@", r"%[a-z][a-z0-9_.]*[a-z0-9]%", r"\$[a-z][\w.]*[a-z0-9]\$",
    r"\[\[\s*[a-z][\w. -]*\]\]", r"«[a-z][a-z0-9_.]*[a-z0-9]»", r"(?<![a-z0-9_])__[a-z][a-z0-9_.]*?__(?![a-z0-9_])", r"(?:<|&lt;)your [a-z][\w. -]*(?:>|&gt;)",
    r"(?:<|&lt;)(?!(?:sub|sup|em|strong|br|hr|li|ul|ol|td|tr|th|div|span|table|body|html|head|img|font|italic|bold)\b)[a-z][a-z0-9_.]+(?:>|&gt;)",
    r"[\[<{(]\s*(?:insert|enter|add|your|type|fill in)\b[^\[\]<>{}()]{1,40}[\]>})]", r"\[[^\[\]]{1,40}\b(?:to be added|to be completed|goes here|here|tbd|tba|placeholder)\b[^\[\]]{0,30}\]",
]
#: Fixed values. Filler text.
FILLER = [
    r"lorem ipsum", r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|tempor|aliqua|ullam\w*|vivamus|consequat|velit|magna|nisi|sed|ut|sit)(?:[\s,]+(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|tempor|aliqua|ullam\w*|vivamus|consequat|velit|magna|nisi|sed|ut|sit)\b){4}",
    r"\bx{3,}(?:\s+x{2,}){2}", r"\b(tbd|tba|fixme|asdf|blah|n/a)(?:[\s,]+\1\b){1}", r"\btodo\s*:\s*(?:write|add|fill|insert|complete|replace|update|fix|describe|check|translate|put|enter)\b", r"\bfixme\b", r"(?:^|[.!?…\n]\s*|\s)sample text\s*(?:[.!\n]|$)", r"\b(?:dummy|filler) text\b(?=\s*(?:[.!:\n]|$))",
    r"\byour (?:\w+ ){0,3}goes here", r"\b(?:type|enter|write|put|insert|paste|add) (?:the |your )[\w. ]{1,30} here\b", r"\breplace this (?:paragraph|text|section|sentence|line)", r"placeholder\s*[–—:-]\s*do not publish", r"\bdo not publish\b", r"\bcoming soon\b",
    r"text folgt(?: in kürze)?", r"\b(?:platzhaltertext|blindtext|beispieltext)\b", r"hier (?:text|ihren? [\w-]+) (?:einfügen|eingeben|eintragen)", r"texte à (?:compléter|venir|insérer|remplacer)", r"(?:insérez|saisissez|collez) (?:ici|votre|le) (?:texte|résumé)", r"résumé à (?:compléter|venir)",
    r"aquí va (?:el|la|su|un)\b", r"(?:inserte|escriba|introduzca|pegue) aquí", r"texto de (?:ejemplo|relleno|prueba|exemplo)", r"(?:insira|escreva|digite|cole) aqui", r"aqui vai [oa]\b", r"(?:o )?texto será inserido",
    r"вставьте (?:сюда )?(?:\S+ )?(?:текст|аннотаци)", r"(?:здесь будет|место для) (?:текст|аннотаци)", r"текст[- ]заполнитель", r"введите (?:сюда )?(?:текст|аннотаци)",
    r"此处(?:填写|输入|插入|添加|为)", r"在此(?:处)?(?:填写|输入|插入)", r"请(?:填写|输入)(?:摘要|正文|标题|内容)", r"示例文本|占位(?:符|文)", r"ここに.{0,14}(?:入力|記入|挿入|書い)", r"(?:サンプル|ダミー)(?:テキスト|文)", r"यह(?:ाँ|ां).{0,24}(?:लिखें|डालें|दर्ज करें|जोड़ें)", r"(?:ใส่|พิมพ์|กรอก).{0,16}ที่นี่",
]
#: Fixed values. Messages of errors and of barred access.
ERRORS = [
    rf"\b(?:http(?:/\d(?:\.\d)?)?|error|status|code|oops!?)\W{{0,4}}[1-5]\d\d\b\W{{0,5}}\s*(?:{_REASON}|$|\n|the {_NOUN})", rf"(?<![0-9a-z,/%-])(?<!\d\.)[45]\d\d\b\s*[|–—:.-]{{0,2}}\s*{_REASON}", rf"{_REASON}\s*[\[(](?:status |code |error |http )?[45]\d\d[\])]",
    rf"\berror [45]\d\d\b", rf"\b(?:fehler|erreur|ошибка|erro)\s*:?\s*[45]\d\d\b", r"(?:错误|エラー)\s*[:：]?\s*[45]\d\d", rf"\bstatus\s*:\s*[45]\d\d\b",
    rf"(?:^|[\n.!?…。！？।”»)]\s*)\s*{_NOUN} not found\s*(?:[.!|\n(\[]|$)", r"\bpage not found\s*[.!]?\s*(?:\n|$)", rf"\bthe {_NOUN} you (?:requested|asked for|are looking for|were looking for|tried to)", rf"\b(?:we|i) (?:could not|couldn.t|cannot|can.t|are unable to|were unable to|are not able to) (?:find|show|load|display|fetch|open|retrieve) (?:the|this|that|your) {_NOUN}",
    rf"\bthis {_NOUN} (?:could not be|cannot be|can.t be) (?:loaded|found|shown|displayed|opened)", rf"\bthis {_NOUN} is (?:temporarily |currently |no longer )(?:offline|unavailable|available|not available)", rf"\b(?:this|the) {_NOUN} (?:you \w+ \w+ )?(?:has been|was) (?:withdrawn from the server|moved or deleted|removed from the server)",
    rf"\blink to (?:this|the) {_NOUN} has expired", rf"\bno {_NOUN} matches this (?:address|url|link)", rf"\b(?:is )?no longer available on (?:our|this) (?:site|server|website)", rf"\bsorry, (?:this|the|that|your|we) ", r"\boops!",
    r"\b(?:an? )?(?:unexpected|unknown|internal) error (?:has )?occurred", r"\bsomething went wrong (?:while|when|on our|with)|\bsomething went wrong\s*(?:[.!\n]|$)", r"\bplease try again\b", r"\btry again later\b", r"\btoo many requests\b", r"\bbad gateway\b", r"\binternal server error\b", r"\bgateway time-?out\b", r"\brequest timed out\b", r"\bservice (?:is )?temporarily unavailable\b",
    r"\bdatabase connection failed", r"\bfatal error\b", r"\bundefined (?:variable|index|function|method|property)\b", r"\bnull ?(?:reference|pointer)(?:exception)?\b\s*:?", r"\btraceback \(most recent", r"\bstack trace\s*:", r"\buncaught (?:type|reference)?error", r"\b(?:article|record|page|document)\.(?:body|text|title)\s+is (?:not set|null|undefined)", r"\.php\b on line \d",
    rf"\byou (?:must|need to|have to) (?:sign|log) ?in\b", r"\bplease (?:sign|log) ?in\b", r"\b(?:sign|log) ?in (?:again )?to (?:see|read|view|access|continue)", r"\byour session has (?:expired|timed out)", rf"\byou do not have (?:access|permission)", r"\baccess denied\b", r"\bsubscription (?:is )?required\b", rf"\b(?:subscribe|register) to (?:read|view|access) (?:this|the) {_NOUN}", r"\bdown for maintenance\b|\boffline for maintenance\b",
    r"seite (?:wurde )?nicht gefunden", r"(?:diese|die) (?:angeforderte )?seite (?:existiert nicht|ist nicht verfügbar)", r"zugriff verweigert", r"bitte (?:melden sie sich an|loggen sie sich ein)", r"vorübergehend nicht (?:verfügbar|erreichbar)", r"(?:ein )?(?:unerwarteter|interner) (?:fehler|serverfehler)",
    r"page (?:\S+ )?(?:est )?introuvable", r"page (?:demandée )?n.existe (?:pas|plus)", r"accès (?:refusé|interdit)", r"veuillez vous (?:connecter|identifier)", r"temporairement indisponible", r"une erreur (?:inattendue |est )", r"erreur (?:interne )?du serveur",
    r"página (?:solicitada |que busca )?no (?:existe|encontrada|se encuentra|disponible|se ha encontrado|fue encontrada)", r"acceso (?:denegado|restringido)", r"inicie sesión", r"temporalmente no disponible|no disponible temporalmente", r"error (?:interno )?del servidor", r"se ha producido un error",
    r"página (?:solicitada )?não (?:existe|encontrada|foi encontrada|disponível)", r"acesso (?:negado|restrito)", r"faça login", r"temporariamente indisponível", r"erro (?:interno )?do servidor", r"ocorreu um erro",
    r"страница (?:\S+ )?не (?:найдена|существует)", r"доступ (?:запрещ[её]н|ограничен|закрыт)", r"войдите (?:в систему|на сайт|, чтобы|в аккаунт)", r"временно недоступ", r"(?:внутренняя )?ошибка сервера", r"произошла ошибка",
    r"(?:页面|网页|文章|内容)(?:不存在|未找到|已被删除|无法(?:显示|访问|加载|打开))", r"找不到(?:该|此|您)?.{0,8}(?:页面|网页|文章|内容)", r"(?:访问被拒绝|拒绝访问|无权访问|请(?:先)?登录)", r"(?:服务|暂时)(?:器)?(?:暂时)?(?:不可用|无法访问)", r"服务器(?:内部)?错误",
    r"(?:ページ|記事|文書)(?:が|は)(?:見つかりません|存在しません|表示できません|ご利用いただけません)", r"アクセス(?:が|は)拒否", r"ログインしてください", r"(?:一時的に|現在)(?:利用|ご利用)(?:でき|いただけ)", r"サーバー?エラー", r"(?:पृष्ठ|पेज).{0,12}(?:नहीं मिला|मौजूद नहीं|उपलब्ध नहीं)", r"(?:ไม่พบ|ไม่มี)หน้า",
]
#: Fixed values. Notices that scripts are required.
SCRIPTS = [
    rf"\b(?:enable|activate|allow|permit|unblock|turn on|switch on)\s+(?:the\s+)?{_JS}\b", rf"\b{_JS} (?:is|are|must be|has to be|have to be|needs to be|need to be|should be|seems? to be|appears? to be)\s+(?:on\b|off\b|enabled|activated|allowed|disabled|blocked|turned|switched|required|needed|deactivated)",
    rf"\b(?:needs|requires)\s+(?:java ?script|scripts|cookies)\b", rf"\b(?:turn|switch) {_JS} on\b", r"does not (?:support|allow|run) (?:java ?script|scripts)", r"\bnoscript\b", r"\bchecking your browser\b", rf"\bwithout {_JS},? (?:this|the) ",
    r"(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java ?script|skripte|cookies)", r"(?:java ?script|skripte) (?:ist|sind|muss|müssen|wird) .{0,30}(?:aktiviert|deaktiviert|benötigt|eingeschaltet|erlaubt)", r"(?:benötigt|erfordert) (?:java ?script|skripte)",
    r"activ(?:er|ez) (?:le )?(?:java ?script|les scripts)", r"java ?script (?:est|doit être) .{0,20}(?:activé|désactivé|requis|nécessaire)", r"nécessite (?:java ?script|les scripts)",
    r"(?:active|activar|habilite|habilitar|permita) (?:el )?(?:java ?script|los scripts)", r"(?:ative|ativar|permita|habilite) (?:o )?(?:java ?script|os scripts)", r"(?:necesita|requiere|precisa de|requer) java ?script", r"java ?script (?:está|debe estar|deve estar) .{0,20}(?:activado|desactivado|habilitado|ativado|desativado|deshabilitado)",
    r"(?:включите|активируйте|разрешите)(?: поддержку)? (?:java ?script|скрипт|cookies)", r"(?:java ?script|скрипты) (?:отключ|должен быть включ|должны быть включ|заблокир)", r"(?:требуется|необходим) java ?script", r"(?:启用|开启|打开|允许).{0,12}(?:java ?script|脚本)", r"(?:java ?script|脚本).{0,8}(?:禁用|未启用|启用后)", r"(?:java ?script|スクリプト).{0,8}(?:有効|オン|許可|必要|無効)", r"(?:java ?script|जावास्क्रिप्ट).{0,16}(?:सक्षम|चालू|सक्रिय|आवश्यक)", r"(?:เปิด|เปิดใช้|อนุญาต).{0,10}(?:java ?script|สคริปต์)",
]
#: At most so many literals are held for a part of a pattern.
_MOST = 1500
_BLANKS, _DIGITS = set(" \t\n\r\f\v"), set("0123456789")


def _rarity(literal: str) -> float:
    return sum(2 if c > "\x7f" else 1 if c.isalpha() else 0.4 if c.isdigit() or c.isspace() else 1.5 for c in literal)


def _better(sets: list[set[str] | None]) -> set[str] | None:
    """The set whose most common literal is rarest, of such the smallest; None if each has the empty one."""
    return max((s for s in sets if s and "" not in s), key=lambda s: (min(map(_rarity, s)), -len(s)), default=None)


def _members(items: list) -> set[str] | None:
    """The characters of a class; None if they are many."""
    out: set[str] = set()
    for op, x in items:
        if op is sre.LITERAL:
            out.add(chr(x))
        elif op is sre.RANGE and x[1] - x[0] < 32:
            out |= {chr(c) for c in range(x[0], x[1] + 1)}
        elif op is sre.CATEGORY and x in (sre.CATEGORY_SPACE, sre.CATEGORY_DIGIT):
            out |= _BLANKS if x is sre.CATEGORY_SPACE else _DIGITS
        else:
            return None
    return out


_NOTHING = ({""}, {""}, {""}, None)
_ANY = (None, {""}, {""}, None)


def _cross(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return None if a is None or b is None or len(a) * len(b) > _MOST else {x + y for x in a for y in b}


def _then(a: tuple, b: tuple) -> tuple:
    pre, suf = _cross(a[0], b[1]), _cross(a[2], b[0])
    return _cross(a[0], b[0]), a[1] if pre is None else pre, b[2] if suf is None else suf, _better([a[3], b[3], _cross(a[2], b[1])])


def _literals(parsed) -> tuple:
    """(all texts that a parsed pattern matches or None, how each begins, how each ends, a set of which each holds one or None)."""
    out = _NOTHING
    for op, x in parsed:
        if op is sre.LITERAL:
            part = ({chr(x)},) * 4
        elif op is sre.IN:
            part = (c,) * 4 if (c := _members(x)) else _ANY
        elif op is sre.BRANCH:
            parts = [_literals(y) for y in x[1]]
            held = [_better([y[0], y[3]]) for y in parts]
            whole = None if any(y[0] is None for y in parts) else set().union(*(y[0] for y in parts))
            part = (whole, set().union(*(y[1] for y in parts)), set().union(*(y[2] for y in parts)), None if any(y is None for y in held) else set().union(*held))
        elif op is sre.SUBPATTERN:
            part = _literals(x[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = x[0], x[1], _literals(x[2])
            part = _NOTHING
            for _ in range(low):
                part = _then(part, inner)
            if high != low:
                if low == 0 and high == 1:
                    part = (None if inner[0] is None else inner[0] | {""}, inner[1] | {""}, inner[2] | {""}, None)
                else:
                    # more of the same: the beginning and the end are still those of the least number
                    part = (None, part[1], part[2], _better([part[0], part[3]]))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _NOTHING
        else:
            part = _ANY
        out = _then(out, part)
    return out


def literals(pattern: str) -> set[str]:
    """Literals of which every match of ``pattern`` holds one."""
    whole, *_, held = parts = _literals(re_parser.parse(pattern, re.A))
    found = _better([whole, held, parts[1], parts[2]])
    if found is None:
        raise ValueError(f"no literal that all matches hold: {pattern}")
    return found


#: Word borders are those of ASCII words, as text of other scripts may adjoin.
_PATTERNS = [re.compile(p, re.A) for p in (*FILLER, *ERRORS, *SCRIPTS, *FIELDS)]


@cache
def _automaton() -> ahocorasick.Automaton:
    """Finds the literals of all patterns, each with the numbers of the patterns that need it."""
    needed: dict[str, list[int]] = {}
    for n, p in enumerate(_PATTERNS):
        for k in literals(p.pattern):
            needed.setdefault(k, []).append(n)
    found = ahocorasick.Automaton()
    for k, numbers in needed.items():
        found.add_word(k, tuple(numbers))
    found.make_automaton()
    return found


def pieces(text: str) -> list[tuple[int, str]]:
    """(place, piece) of the evidence in a text: of all patterns only those are tried, on the whole text, of which it holds a literal."""
    small = text.lower()
    if len(small) != len(text):
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    tried = {n for numbers in {x for _, x in _automaton().iter(small)} for n in numbers}
    return sorted((m.start() + len(m.group()) - len(m.group().lstrip()), m.group().strip()) for n in tried for m in _PATTERNS[n].finditer(small))


#: What a piece may begin with that belongs to the sentence or line before.
_LEAD = "\n.!?…。！？”») "


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of the texts that have evidence: one row for each piece, and one for each other line that isn't blank."""
    for b in batches:
        rows = []
        for doc, host, copy, text in zip(b["doc_id"], b["host"], b["copy"], b["text"]):
            hits: dict[int, list[str]] = {}
            for place, hit in pieces(text):
                place += len(hit) - len(hit.lstrip(_LEAD))
                hits.setdefault(text.rfind("\n", 0, place) + 1, []).append(hit)
            begin = 0
            for line in text.split("\n") if hits else []:
                if begin in hits or line.strip():
                    rows += [(doc, host, copy, hit, line) for hit in hits.get(begin, [None])]
                begin += len(line) + 1
        yield pd.DataFrame(rows, columns=["doc_id", "host", "copy", "evidence", "line"])


def line_key(line: Column) -> Column:
    """The key of a normalised line: small letters, digits as 0, no blanks around."""
    return F.xxhash64(F.translate(F.lower(F.trim(line)), "123456789", "000000000"))


def exact_key(line: Column) -> Column:
    """The key of a line with its digits."""
    return F.xxhash64(F.lit("exact"), F.lower(F.trim(line)))


def boilerplate(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, key): lines, by both keys, that recur in at least ``share`` of the documents of a host; repeated rows of a document are one."""
    lines = F.split("text", "\n")
    keys = F.array_union(F.transform(lines, line_key), F.transform(lines, exact_key))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.coalesce("source", F.lit("")).alias("host"), keys.alias("keys"))
    sizes = texts.groupBy("host").agg(F.countDistinct("doc_id").alias("size")).withColumnRenamed("host", "h")
    counts = texts.select("doc_id", "host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") > 1)
    return counts.join(sizes, F.col("host") == F.col("h")).where(F.col("n") >= share * F.col("size")).select("host", "key")


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, evidence): the documents whose residual has evidence of a template, filler, an error page or a barred page, with its first piece.

    The residual is the text without the lines that recur on its host (its source; null is a host of its own), so
    evidence in such a line doesn't count where other content remains: a line that doesn't recur with the same digits.
    Where none remains, the document is the notice itself, and all its evidence counts. Null and empty texts have none;
    repeated rows give one row.
    """
    texts = spread(documents.where(F.length("text") > 0)).select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("copy"), "text")
    lines = texts.mapInPandas(_search, "doc_id bigint, host string, copy bigint, evidence string, line string").withColumn("key", F.when(F.col("evidence").isNull(), exact_key(F.col("line"))).otherwise(line_key(F.col("line")))).drop("line")
    known = boilerplate(documents).select(F.col("host").alias("h"), F.col("key").alias("k"))
    judged = lines.join(known, (F.col("host") == F.col("h")) & (F.col("key") == F.col("k")), "left").withColumn("own", F.col("k").isNull())
    first = F.when(F.max("own"), F.min(F.when(F.col("own"), F.col("evidence")))).otherwise(F.min("evidence"))
    by_text = judged.groupBy("doc_id", "host", "copy").agg(first.alias("evidence")).where("evidence is not null")
    return by_text.groupBy("doc_id").agg(F.min("evidence").alias("evidence"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that have no residue."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
