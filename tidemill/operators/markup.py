"""Tags and attributes of a body as SQL: they are taken out first, and tested as plain values."""

from __future__ import annotations

#: Elements and ids in which an application mounts itself.
MOUNT_TAGS, MOUNT_IDS = ("div", "main", "section", "app-root"), ("root", "app", "__next", "__nuxt", "application")
#: Marks of a page that scripts bring to life, and of a state that it carries.
HYDRATION = ("__next_data__", "__nuxt__", "__initial_state__", "window.__preloaded_state__", "data-reactroot")
STATES = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__")


def has_any(x: str, marks) -> str:
    """Whether a text holds one of some plain marks."""
    return "(" + " OR ".join(f"position('{m}' IN {x}) > 0" for m in marks) + ")"


def one_of(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def tags(d, body: str) -> str:
    """The opening tags of a body."""
    return d.found(body, "<[A-Za-z][^<>]*>")


def name(d, tag: str) -> str:
    return f"lower({d.ext(tag, '^<([A-Za-z][A-Za-z0-9-]*)', 1)})"


def attribute(d, tag: str, key: str) -> str:
    """A quoted attribute of a tag in lower case; empty if there is none."""
    return f"lower({d.ext(tag, rf'(?i)[^A-Za-z0-9-]{key}\s*=\s*[\x22\x27]([^\x22\x27]*)', 1)})"


def scripts(d, body: str) -> str:
    """The opening tags of scripts that come from a file."""
    return d.among(tags(d, body), lambda t: f"{name(d, t)} = 'script' AND {d.rx(t, '(?i)[^a-z]src=')}")


def empty_mount(d, body: str, tag_names=MOUNT_TAGS, ids=MOUNT_IDS) -> str:
    """Whether an element that an application mounts itself in has nothing inside."""
    bare = d.found(body, r"<[A-Za-z][^<>]*>\s*</[A-Za-z-]+")
    closes = lambda t: f"lower({d.ext(t, '</([A-Za-z-]+)$', 1)})"
    return d.some(bare, lambda t: f"{one_of(name(d, t), tag_names)} AND {one_of(closes(t), tag_names)} AND {one_of(attribute(d, t, 'id'), ids)}")
