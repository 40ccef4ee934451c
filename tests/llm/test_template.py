"""Chat templates as they are commonly written, against text written by hand; the language piece by piece; what is refused."""

from __future__ import annotations

import time

import pytest

from tidemark.llm import template
from tidemark.llm.template import TemplateError, compile_template


def show(src, trim=False, **env):
    return compile_template(src, trim)(**env)[0]


# Three templates in the manner of published ones.
TURNS = """{%- if tools %}
    {{- '<|start|>system\\n' }}
    {%- if messages[0].role == 'system' %}
        {{- messages[0].content + '\\n\\n' }}
    {%- endif %}
    {{- "# Tools" }}
    {%- for tool in tools %}
        {{- "\\n" }}
        {{- tool | tojson }}
    {%- endfor %}
    {{- "<|stop|>\\n" }}
{%- elif messages[0].role == 'system' %}
    {{- '<|start|>system\\n' + messages[0].content + '<|stop|>\\n' }}
{%- endif %}
{%- set ns = namespace(last=-1) %}
{%- for m in messages if m.role == 'user' %}{% set ns.last = loop.index0 %}{% endfor %}
{%- for message in messages %}
    {%- if message.role == 'user' or (message.role == 'system' and not loop.first) %}
        {{- '<|start|>' + message.role + '\\n' + message.content + '<|stop|>' + '\\n' }}
    {%- elif message.role == 'assistant' %}
        {{- '<|start|>assistant\\n' }}{% generation %}{{- message.content if message.content is string else '' }}
        {%- if message.tool_calls is defined and message.tool_calls %}
            {%- for call in message.tool_calls %}
                {{- '\\n<call>' ~ {'name': call.name, 'arguments': call.arguments}|tojson ~ '</call>' }}
            {%- endfor %}
        {%- endif %}{{- '<|stop|>' }}{% endgeneration %}
        {{- '\\n' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}{{- '<|start|>assistant\\n' }}{% endif %}
{{- ns.last }}"""
HEADERS = """{{ bos }}{% if messages[0]['role'] == 'system' %}{% set system = messages[0]['content']|trim %}{% set messages = messages[1:] %}{% else %}{% set system = "" %}{% endif %}
{%- for message in messages %}
{%- set content = '[' + message['role'] + ']\\n\\n' + message['content'] | trim + '[end]' %}
{%- if loop.index0 == 0 and system != '' %}{{ '[system]\\n\\n' ~ system ~ '[end]' }}{% endif %}
{{- content }}
{%- endfor %}"""
ALTERNATE = """{%- if messages[0]["role"] == "system" %}
{%- set system_message = messages[0]["content"] %}
{%- set loop_messages = messages[1:] %}
{%- else %}
{%- set loop_messages = messages %}
{%- endif %}
{%- for message in loop_messages %}
{%- if (message["role"] == "user") != (loop.index0 % 2 == 0) %}
{{- raise_exception("roles must take turns, from " ~ loop.index) }}
{%- endif %}
{%- if message["role"] == "user" %}
{%- if loop.last and system_message is defined %}
{{- "[INST]" + system_message + "\\n\\n" + message["content"] + "[/INST]" }}
{%- else %}
{{- "[INST]" + message["content"] + "[/INST]" }}
{%- endif %}
{%- elif message["role"] == "assistant" %}
{{- " " + message["content"].strip() + "</s>" }}
{%- else %}
{{- raise_exception("no such role") }}
{%- endif %}
{%- endfor %}"""
TALK = [{"role": "system", "content": "Be kind."}, {"role": "user", "content": " Hi "}, {"role": "assistant", "content": "Hello. "}, {"role": "user", "content": "Bye"}]


def test_turns_with_tools():
    want = "<|start|>system\nBe kind.<|stop|>\n<|start|>user\n Hi <|stop|>\n<|start|>assistant\nHello. <|stop|>\n<|start|>user\nBye<|stop|>\n<|start|>assistant\n1"
    text, spans = compile_template(TURNS)(messages=TALK, add_generation_prompt=True)
    assert text == want and [text[a:b] for a, b in spans] == ["Hello. <|stop|>"]
    calls = [TALK[1], {"role": "assistant", "content": None, "tool_calls": [{"name": "f", "arguments": {"x": [1, None, True, "é"]}}]}]
    got = show(TURNS, messages=calls, tools=[{"n": 1}])
    assert got == '<|start|>system\n# Tools\n{"n": 1}<|stop|>\n<|start|>user\n Hi <|stop|>\n<|start|>assistant\n\n<call>{"name": "f", "arguments": {"x": [1, null, true, "é"]}}</call><|stop|>\n0'


def test_headers():
    assert show(HEADERS, messages=TALK, bos="<s>") == "<s>[system]\n\nBe kind.[end][user]\n\nHi[end][assistant]\n\nHello.[end][user]\n\nBye[end]"
    assert show(HEADERS, messages=TALK[1:2], bos="") == "[user]\n\nHi[end]"


def test_alternating():
    assert show(ALTERNATE, messages=TALK) == "[INST] Hi [/INST] Hello.</s>[INST]Be kind.\n\nBye[/INST]"
    assert show(ALTERNATE, messages=TALK[1:2]) == "[INST] Hi [/INST]"
    with pytest.raises(TemplateError, match="from 1"):
        show(ALTERNATE, messages=TALK[2:])


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("{% set x = 1 %}{% set x = x + 2 %}{{ x }}", "3"),
        ("{% if true %}{% set x = 'in' %}{% endif %}{{ x }}{% for i in [1] %}{% set x = 'loop' %}{% endfor %}{{ x }}", "inin"),
        ("{% set x %}a{{ 1 }}b{% endset %}[{{ x }}]", "[a1b]"),
        ("{% set ns = namespace(n=0) %}{% for i in range(5) if i % 2 %}{% set ns.n = ns.n + i %}{% endfor %}{{ ns.n }}", "4"),
        ("{% for m in ms if m.r == 'u' %}{{ m.c }}{{ loop.length }}{% else %}none{% endfor %}", "a2c2"),
        ("{% for m in ms if m.r == 'x' %}{{ m.c }}{% else %}none{% endfor %}", "none"),
        ("{% for k, v in {'a': 1, 'b': 2}.items() %}{{ k }}={{ v }};{% endfor %}", "a=1;b=2;"),
        ("{% for k, v in d | dictsort %}{{ k }}{{ v }}{% endfor %}", "p1q2"),
        ("{% for i in range(10) %}{% if i == 2 %}{% continue %}{% endif %}{% if i == 4 %}{% break %}{% endif %}{{ i }}{% endfor %}", "013"),
        ("{% for x in 'abc' %}{{ loop.previtem }}{{ x }}{{ loop.nextitem }}{{ loop.revindex }},{% endfor %}", "ab3,abc2,bc1,"),
        ("{{ ms[1:]|length }}{{ 'abcdef'[::-1] }}{{ 'abcdef'[-2:] }}{{ ms[-1].c }}{{ ms[0]['c'] }}", "2fedcbaefca"),
        ("{{ 7 // 2 }}{{ 7 % 4 }}{{ 1 / 2 }}{{ -3 + 1 }}{{ 2 * 3 + 1 }}", "330.5-27"),
        ("{{ 1 < 2 <= 2 }}{{ 1 < 2 < 2 }}{{ 'a' not in 'bc' }}{{ not 'a' in 'abc' }}", "truefalsetruefalse"),
        ("{{ x is defined }}{{ d is defined and d.zz is not defined }}{{ none is none }}{{ d is mapping }}{{ 3 is odd }}{{ 4 is divisibleby(2) }}{{ 's' is string }}", "falsetruetruetruetruetruetrue"),
        ("{{ x | default('y') }}{{ '' | default('z', true) }}{{ none | default('w') }}", "yzw"),
        ("{{ ms | map(attribute='c') | join('-') }}{{ ms | selectattr('r', 'equalto', 'u') | list | length }}{{ ms | rejectattr('r', 'eq', 'u') | first | tojson }}", 'a-b-c2{"r": "a", "c": "b"}'),
        ("{{ 'a b c'.split(' ')[1] }}{{ 'x'.startswith('x') }}{{ 'abc'.replace('b', '') }}{{ d.get('p') }}{{ d.get('zz', 9) }}{{ ','.join(['1', 2]) }}", "btrueac191,2"),
        ("{% macro f(a, b='!') %}<{{ a }}{{ b }}>{% endmacro %}{{ f('x') }}{{ f('y', b='?') }}", "<x!><y?>"),
        ("{% raw %}{{ not }}{% this %}{% endraw %}{{ '{{ }} %}' }}{# {{ no }} #}", "{{ not }}{% this %}{{ }} %}"),
        ("{{ (1, 2)[1] }}{{ [1, 2] + [3] }}{{ 'a' 'b' }}{{ 1 if x }}{{ [] | tojson(indent=2) }}", "2[1, 2, 3]ab[]"),
        ("{{ d | tojson(indent=1) }}", '{\n "q": 2,\n "p": 1\n}'),
        ("a  {{- 1 -}}  b  {%- if true -%}  c  {%- endif %} d", "a1bc d"),
    ],
)
def test_pieces(src, want):
    ms = [{"r": "u", "c": "a"}, {"r": "a", "c": "b"}, {"r": "u", "c": "c"}]
    assert show(src, ms=ms, d={"q": 2, "p": 1}) == want


def test_trimmed_lines():
    src = "{% for x in xs %}\n  {% if x %}\n    <{{ x }}>\n  {% endif %}\n{% endfor %}\nend {% if true %}!{% endif %}\n"
    assert show(src, True, xs=[1, 0, 2]) == "    <1>\n    <2>\nend !"


def test_folded():
    tree = template.simplify(template.parse("{{ 2 + 3 * 4 }}{% if 'a' in 'abc' and not false %}{{ ('x' | upper) ~ '!' }}{% else %}{{ y }}{% endif %}{{ [1, 2][0] }}{{ range(3) | length }}"))
    assert tree[0] == ("text", "14X!") and [n[0] for n in tree] == ["text", "out", "text"]
    # what would fail is left for its time, which here never comes
    assert show("{% if x %}{{ 1 / 0 }}{{ raise_exception('no') }}{% endif %}ok") == "ok"


@pytest.mark.parametrize(
    "bad",
    [
        "{{ ''.__class__.mro() }}", "{{ x.format(y) }}", "{{ x.encode() }}", "{{ (1).real() }}", "{{ range }}{{ range() }}", "{{ open('f') }}", "{% set a.b = 1 %}", "{% set = 1 %}", "{% set x %}",
        "{% for x %}{% endfor %}", "{% for a, b in [1] %}{% endfor %}", "{% break %}", "{% macro f(a) %}{% endmacro %}{{ f(1, 2) }}", "{{ x is nothing }}", "{{ x[1:2:3:4] }}", "{{ 'a' - 1 }}", "{{ 1 / 0 }}",
        "{{ range(10000000) }}", "{% for i in range(100000) %}{% for j in range(100000) %}{% endfor %}{% endfor %}", "{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}", "{% raw %}x", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}",
        "{% set ns = namespace(s='xxxxxxxxxxxxxxxx') %}{% for i in range(100) %}{% set ns.s = ns.s ~ ns.s %}{% endfor %}", "{% set ns = namespace(n=9) %}{% for i in range(100) %}{% set ns.n = ns.n * ns.n %}{% endfor %}", "{{ f | tojson }}{{ namespace() | tojson }}",
    ],
)
def test_refused(bad):
    began = time.perf_counter()
    with pytest.raises(TemplateError):
        show(bad, x="y")
    assert time.perf_counter() - began < 20


def test_no_python_inside():
    for src in ("{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ m.__init__ }}", "{{ ms[0].__len__ }}", "{{ namespace.__globals__ }}", "{{ ns.__slots__ }}", "{{ range.__self__ }}"):
        assert show("{% set ns = namespace(a=1) %}" + src, x="y", m={"a": 1}, ms=[{}]) == ""


def test_conversations_that_fail_and_long_ones(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", long), (2, 1, "assistant", "é" * 1000), (3, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, error int, messages int")
    got = {r["conv_id"]: r for r in template.format_conversations(df, ALTERNATE).collect()}
    assert got[1]["text"] is None and got[1]["generated"] is None and "from 2" in got[1]["error"] and got[1]["n_messages"] == 2
    assert got[2]["text"] == f"[INST]{long}[/INST] {'é' * 1000}</s>" and got[2]["error"] is None and got[3]["text"] == "[INST]x[/INST]"
    many = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'t' AS text")
    (one,) = template.format_conversations(many).collect()
    assert one["n_messages"] == 20_000 and len(one["generated"].split(",")) == 10_000
    with pytest.raises(TemplateError):
        template.format_conversations(df, "{% if %}")
