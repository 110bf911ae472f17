"""What a source or provider says of itself, checks of its settings, and a conformance suite."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

from ..functions.display import duration
from ..operators.store import BadRequest

API_VERSION = 1
PLUGIN_KINDS = ("source", "provider", "code")
#: Services that speak one chat protocol: base address, paths of chat and embeddings, default
#: models (fixed values; no path, no such capability).
PRESETS = {
    "zai": ("https://api.z.ai/api", "/paas/v4/chat/completions", None, {"complete": "glm-4.6"}),
    "openrouter": ("https://openrouter.ai/api", "/v1/chat/completions", "/v1/embeddings", {"complete": "moonshotai/kimi-k2", "embed": "openai/text-embedding-3-small"}),
    "moonshot": ("https://api.moonshot.ai", "/v1/chat/completions", None, {"complete": "kimi-k3"}),
    "deepseek": ("https://api.deepseek.com", "/chat/completions", None, {"complete": "deepseek-v4-pro"}),
    "groq": ("https://api.groq.com/openai", "/v1/chat/completions", None, {"complete": "openai/gpt-oss-120b"}),
    "together": ("https://api.together.ai", "/v1/chat/completions", "/v1/embeddings", {"complete": "MiniMaxAI/MiniMax-M3", "embed": "intfloat/multilingual-e5-large-instruct"}),
    "vllm": ("http://localhost:8000", "/v1/chat/completions", "/v1/embeddings", {}),
    "lmstudio": ("http://localhost:1234", "/v1/chat/completions", "/v1/embeddings", {}),
}


@dataclass(frozen=True)
class Setting:
    name: str
    type: str = "string"
    required: bool = False
    default: str = ""
    doc: str = ""


@dataclass(frozen=True)
class Secret:
    key: str
    optional: bool = False
    doc: str = ""


def _whole(v) -> int:
    if isinstance(v, bool):
        raise ValueError
    return int(v)


def _flag(v) -> bool:
    if isinstance(v, bool):
        return v
    return {"true": True, "false": False}[str(v).lower()]


def _address(v) -> str:
    if not re.match(r"https?://[^/\s]+", v):
        raise ValueError
    return v


def _listed(v) -> list[str]:
    if isinstance(v, str) or not all(isinstance(x, str) for x in v):
        raise ValueError
    return list(v)


READ = {"string": str, "url": _address, "int": _whole, "bool": _flag, "string_list": _listed, "duration": duration}


@dataclass(frozen=True)
class Manifest:
    name: str
    kind: str
    summary: str = ""
    api_version: int = API_VERSION
    capabilities: frozenset[str] = frozenset()
    settings: tuple[Setting, ...] = ()
    secrets: tuple[Secret, ...] = ()
    default_models: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in PLUGIN_KINDS or self.api_version != API_VERSION or not re.fullmatch(r"[a-z][a-z0-9_-]*", self.name):
            raise BadRequest(f"{self.name!r} isn't a plugin of a known kind and version")
        unknown = [s.type for s in self.settings if s.type not in READ]
        if unknown:
            raise BadRequest(f"{self.name} declares settings of unknown types: {', '.join(unknown)}")

    def read(self, given: Mapping) -> dict:
        """The settings in their types; an undeclared, missing or malformed one is refused. Where
        none is given a default isn't put in: only the plugin knows what it means."""
        declared = {s.name: s for s in self.settings} | {s.key: Setting(s.key, required=not s.optional, doc=s.doc) for s in self.secrets}
        odd = sorted(given.keys() - declared.keys())
        if odd:
            raise BadRequest(f"{self.name} has no setting {', '.join(odd)}")
        lost = sorted(n for n, s in declared.items() if s.required and given.get(n) in (None, ""))
        if lost:
            raise BadRequest(f"{self.name} needs {', '.join(f'{n} ({declared[n].doc})' if declared[n].doc else n for n in lost)}")
        out = {}
        for name, value in given.items():
            try:
                out[name] = READ[declared[name].type](value)
            except (ValueError, TypeError, KeyError) as e:
                raise BadRequest(f"{self.name}: {name} isn't of type {declared[name].type}") from e
        return out

    def json(self) -> str:
        return json.dumps(asdict(self) | {"capabilities": {c: c in self.capabilities for c in ("embed", "complete", "repo_remotes")}})


def preset(name: str) -> Manifest:
    """A provider by its preset, with what it can do."""
    _, chat, vectors, models = PRESETS[name]
    able = frozenset(c for c, path in (("complete", chat), ("embed", vectors)) if path)
    return Manifest(name, "provider", capabilities=able, settings=(Setting("model"), Setting("base_url", "url")), secrets=(Secret("api_key", optional=not models),), default_models=models)


#: What is asserted of a source (fixed values).
CHECKS = ("cursors", "timestamps", "identity", "idempotent", "resumable", "completion", "error")


@dataclass
class Findings:
    found: list[tuple[str, str]] = field(default_factory=list)
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def conforms(changes: Callable[[dict | None], Iterable[tuple[list[dict], dict]]], documents: int, resume_after: int = 0, again: tuple[str, ...] = ("commit",), failing: Callable[[], Iterable] | None = None) -> Findings:
    """Runs the checks on ``changes(cursor)``, which yields ``(documents, cursor)`` batches of one
    unchanged source: every batch has a cursor; documents have their times and identity; a
    second full read gives the same; reading on from a batch's cursor gives what came after it
    and repeats nothing but types in ``again``; the stream ends with ``documents`` documents;
    and an error ends it (``failing()`` is a stream with one)."""
    out = Findings()

    def check(name: str, problems: list[str], possible: bool = True) -> None:
        (out.ran if possible else out.skipped).append(name)
        out.found += [(name, p) for p in problems] if possible else []

    batches = list(changes(None))
    every = [d for rows, _ in batches for d in rows]
    check("completion", [] if len(every) == documents else [f"{len(every)} documents, not {documents}"])
    check("cursors", [f"batch {i} has none" for i, (_, cursor) in enumerate(batches) if not cursor], bool(batches))
    check("timestamps", [d.get("doc_id", "?") for d in every if not d.get("created_at") or not d.get("updated_at")], bool(every))
    good = lambda d: all(d.get(k) for k in ("doc_id", "source", "type", "url")) and d["doc_id"].startswith(f"{d['source']}:{d['type']}:")
    check("identity", [str(d.get("doc_id")) for d in every if not good(d)] + [f"{i} twice" for i in {d["doc_id"] for d in every} if sum(d["doc_id"] == i for d in every) > 1], bool(every))
    second = [d for rows, _ in changes(None) for d in rows]
    check("idempotent", [] if second == every else ["a second read differs"])
    if len(batches) > resume_after + 1:
        rest = [d for rows, _ in changes(batches[resume_after][1]) for d in rows]
        before = {d["doc_id"] for rows, _ in batches[: resume_after + 1] for d in rows}
        wanted = [d["doc_id"] for rows, _ in batches[resume_after + 1 :] for d in rows]
        ids = [d["doc_id"] for d in rest]
        check("resumable", [f"{i} is lost" for i in wanted if i not in ids] + [f"{d['doc_id']} came before" for d in rest if d["doc_id"] in before and d["type"] not in again])
    else:
        check("resumable", [], False)
    if failing is None:
        check("error", [], False)
    else:
        try:
            list(failing())
            check("error", ["the stream went on to its end"])
        except Exception:  # noqa: BLE001  any error is what is asked for
            check("error", [])
    return out
