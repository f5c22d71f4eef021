"""Telling git URLs from paths, by the transport that a source names."""

# The transports that git clones from.
TRANSPORTS = ["https", "http", "ssh", "git", "git+ssh", "file"]
#: The only transports that a server may be asked to clone by.
SAFE = ["https", "http"]


def transport(source: str) -> str | None:
    """The transport of a URL, ``scp`` for ``user@host:path``, None for a path of this machine."""
    scheme, mark, _ = source.partition("://")
    if mark:
        return scheme if scheme in TRANSPORTS else None
    place, colon, path = source.partition(":")
    user, at, host = place.partition("@")
    named = all(name and all(c.isalnum() or c in "_.-" for c in name) for name in (user, host))
    return "scp" if colon and at and named and not path.startswith("/") else None


def is_git_url(source: str) -> bool:
    return transport(source) is not None


def require_safe(source: str) -> str:
    """The source, unless it is a git URL of a transport that a server must not use."""
    way = transport(source)
    if way is not None and way not in SAFE:
        raise ValueError(f"only {' and '.join(SAFE)} URLs are cloned here, not {way}")
    return source
