"""Command line: sanitises one file or folder of HTML."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .functions.encoding import decode
from .functions.markdown import markdown_to_html
from .functions.sanitizer import Config, sanitize


def _config_file(path: str) -> str:
    if Path(path).stat().st_size > 512 * 1024:
        raise SystemExit(f"{path}: over 512 KiB, no configuration")
    return Path(path).read_text()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievedom", description="Sanitise HTML from a file or from standard input.")
    p.add_argument("path", nargs="?", default="-")
    p.add_argument("-f", "--fragment", action="store_true", help="the body's inner HTML only")
    p.add_argument("--md", action="store_true", help="the input is Markdown")
    p.add_argument("-o", "--output")
    p.add_argument("--config", help="JSON configuration")
    p.add_argument("--config-file")
    p.add_argument("--preset", help="strict, default, permissive, trusted")
    p.add_argument("--allow-attr-prefix", action="append", default=[])
    a, _ = p.parse_known_args(argv)
    patch = a.config or (_config_file(a.config_file) if a.config_file else None)
    config = Config.resolve(a.preset, patch)
    if a.allow_attr_prefix:
        config = Config(**{**config.__dict__, "customAttrPrefixes": config.customAttrPrefixes + tuple(a.allow_attr_prefix)})
    text = sys.stdin.read() if a.path == "-" else decode(Path(a.path).read_bytes())
    if a.md:
        text = markdown_to_html(text)
    out = sanitize(text, config, a.fragment)
    Path(a.output).write_text(out) if a.output else print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
