"""The ordered signature rules of license scans: which words say which license."""

from __future__ import annotations

from dataclasses import dataclass

__all__ = ["BASE_PHRASES", "RULES", "Rule", "padded"]


@dataclass(frozen=True)
class Rule:
    """A signature. number orders rules (priority first), keyword stands, as words in a row, in every match, needed is a pattern that every match holds, label None says that what matches is no license, base marks the three fixed phrases, confidence is from 0 to 1."""

    number: int
    priority: int
    keyword: str
    needed: str
    pattern: str
    label: str | None
    base: bool
    confidence: float


#: The phrases whose places are counted, and their labels.
BASE_PHRASES = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache", "apache-2"), ("cc by nc", "cc by", "cc-by-nc"))

_L, _V = "licen[cs]e", "(version |v )?v?"
#: (label, keyword, name): a name that stands for its license. Words are lower-case runs of letters and digits, one blank between them.
NAMES = (
    ("mit", "mit", f"mit( x11)? {_L}"), ("mit", "expat", f"expat {_L}"), ("mit-0", "mit", f"mit no attribution( {_L})?"), ("x11", "x11", f"x11 {_L}"),
    ("apache-2", "apache", f"apache( software)? {_L} {_V}2( 0)?"), ("apache-2", "apache", "apache 2( 0)?"), ("apache-2", "asl", "asl 2( 0)?"),
    ("apache-1-1", "apache", f"apache( software)? {_L} {_V}1 1"), ("apache-1-0", "apache", f"apache( software)? {_L} {_V}1 0"), ("apache", "apache", f"apache( software)? {_L}"),
    ("bsd-2-clause", "bsd", f"(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)( {_L})?"), ("bsd-3-clause", "bsd", f"(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)( {_L})?"),
    ("bsd-4-clause", "bsd", f"(bsd 4 clause|4 clause bsd|original bsd)( {_L})?"), ("bsd-0-clause", "bsd", f"(0bsd|zero clause bsd|bsd zero clause)( {_L})?"), ("bsd", "bsd", f"bsd( style)? {_L}"),
    ("gpl-1", "gnu", f"gnu general public {_L} {_V}1( 0)?( only)?"), ("gpl-2", "gnu", f"gnu general public {_L} {_V}2( 0)?( only)?"), ("gpl-2-or-later", "gnu", f"gnu general public {_L} {_V}2( 0)? (or|and) (at your option )?(any )?later( version)?"),
    ("gpl-3", "gnu", f"gnu general public {_L} {_V}3( 0)?( only)?"), ("gpl-3-or-later", "gnu", f"gnu general public {_L} {_V}3( 0)? (or|and) (any )?later( version)?"), ("gpl", "gnu", f"gnu general public {_L}"),
    ("gpl-2", "gpl", f"(gnu )?gpl {_V}2( 0)?( only)?"), ("gpl-3", "gpl", f"(gnu )?gpl {_V}3( 0)?( only)?"), ("gpl-2-or-later", "gpl", f"(gnu )?gpl {_V}2( 0)? or later"), ("gpl-3-or-later", "gpl", f"(gnu )?gpl {_V}3( 0)? or later"),
    ("gpl-2", "gplv2", "(gnu )?gplv2"), ("gpl-3", "gplv3", "(gnu )?gplv3"), ("gpl", "gpl", f"gpl {_L}"),
    ("lgpl-2", "gnu", f"gnu library general public {_L}( {_V}2( 0)?)?"), ("lgpl-2-1", "gnu", f"gnu lesser general public {_L} {_V}2 1"), ("lgpl-3", "gnu", f"gnu lesser general public {_L} {_V}3( 0)?"), ("lgpl", "gnu", f"gnu lesser general public {_L}"),
    ("lgpl-2-1", "lgpl", f"(gnu )?lgpl {_V}2 1"), ("lgpl-3", "lgpl", f"(gnu )?lgpl {_V}3( 0)?"), ("lgpl-2-1", "lgplv2", "lgplv2 1"), ("lgpl-3", "lgplv3", "(gnu )?lgplv3"),
    ("agpl-3", "affero", f"(gnu )?affero general public {_L}( {_V}3( 0)?)?"), ("agpl-3", "agpl", f"(gnu )?agpl {_V}3( 0)?"), ("agpl-3", "agplv3", "(gnu )?agplv3"), ("gfdl", "gnu", f"gnu free documentation {_L}( {_V}1 [123])?"), ("gfdl", "gfdl", f"gfdl( {_V}1 [123])?"),
    ("mpl-1-1", "mozilla", f"mozilla public {_L} {_V}1 1"), ("mpl-2", "mozilla", f"mozilla public {_L} {_V}2( 0)?"), ("mpl", "mozilla", f"mozilla public {_L}"), ("mpl-2", "mpl", f"mpl {_V}2( 0)?"), ("mpl-1-1", "mpl", f"mpl {_V}1 1"),
    ("epl-1", "eclipse", f"eclipse public {_L} {_V}1( 0)?"), ("epl-2", "eclipse", f"eclipse public {_L} {_V}2( 0)?"), ("epl", "eclipse", f"eclipse public {_L}"), ("epl-2", "epl", f"epl {_V}2( 0)?"), ("epl-1", "epl", f"epl {_V}1( 0)?"),
    ("edl-1", "eclipse", f"eclipse distribution {_L}( {_V}1( 0)?)?"), ("cddl-1", "cddl", f"cddl( {_V}1( [01])?)?"), ("cddl-1", "common development", f"common development and distribution {_L}( {_V}1( [01])?)?"), ("cpl-1", "common public", f"common public {_L}( {_V}1( 0)?)?"), ("eupl-1-2", "eupl", f"eupl {_V}1 2"),
    ("eupl", "european union", f"european union public {_L}( {_V}1 [012])?"), ("isc", "isc", f"isc {_L}"), ("zlib", "zlib", f"zlib( libpng)? {_L}"), ("bsl-1", "boost", f"boost software {_L}( {_V}1( 0)?)?"), ("unlicense", "unlicense", "(the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"), ("artistic-1", "artistic", f"artistic {_L} {_V}1( 0)?"), ("artistic-2", "artistic", f"artistic {_L} {_V}2( 0)?"), ("artistic", "artistic", f"artistic {_L}"), ("postgresql", "postgresql", f"postgresql {_L}"),
    ("python-2", "python", f"python( software foundation)? {_L}( {_V}2( 0)?)?"), ("php-3", "php", f"php {_L}( {_V}3( 01)?)?"), ("ruby", "ruby", f"ruby {_L}"), ("openssl", "openssl", f"openssl {_L}"), ("ofl-1-1", "ofl", f"(sil )?ofl( {_V}1 1)?"),
    ("ofl-1-1", "sil", f"sil open font {_L}( {_V}1 1)?"), ("ncsa", "ncsa", f"(university of illinois )?ncsa( open source)? {_L}"), ("ms-pl", "microsoft public", f"microsoft public {_L}"), ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_L}"), ("osl-3", "open software", f"open software {_L}( {_V}3( 0)?)?"),
    ("afl-3", "academic free", f"academic free {_L}( {_V}3( 0)?)?"), ("upl-1", "universal permissive", f"universal permissive {_L}( {_V}1( 0)?)?"), ("bsl-1-1", "business source", f"business source {_L}( {_V}1 1)?"), ("sspl-1", "sspl", f"sspl( {_V}1)?"), ("sspl-1", "server side", f"server side public {_L}( {_V}1)?"),
    ("elastic-2", "elastic", f"elastic {_L}( {_V}2( 0)?)?"), ("odbl-1", "odbl", f"odbl( {_V}1( 0)?)?"), ("odbl-1", "open database", f"open database {_L}( {_V}1( 0)?)?"), ("odc-by", "commons attribution", f"open data commons attribution {_L}( {_V}1( 0)?)?"), ("pddl-1", "pddl", "pddl( 1 0)?"),
    ("cc0-1", "cc0", f"(cc )?cc0( {_V}1( 0)?)?( universal)?"), ("cc-pdm", "domain mark", "public domain mark( 1 0)?"), ("cc-by-nc-nd", "cc by", f"cc by nc nd( {_V}[1234]( [05])?)?"),
    ("cc-by-nc-sa", "cc by", f"cc by nc sa( {_V}[1234]( [05])?)?"), ("cc-by-nc-sa", "creative commons", f"creative commons attribution (non commercial|noncommercial) (share alike|sharealike)( {_V}[1234]( [05])?)?"), ("cc-by-nc-nd", "creative commons", f"creative commons attribution (non commercial|noncommercial) (no derivs|noderivs|no derivatives|noderivatives)( {_V}[1234]( [05])?)?"),
    ("cc-by-nc", "cc by", f"cc by nc( {_V}[1234]( [05])?)?"), ("cc-by-nc", "creative commons", f"creative commons attribution (non commercial|noncommercial)( {_V}[1234]( [05])?)?"), ("cc-by-sa", "cc by", f"cc by sa( {_V}[1234]( [05])?)?"), ("cc-by-sa", "creative commons", f"creative commons attribution (share alike|sharealike)( {_V}[1234]( [05])?)?"),
    ("cc-by-nd", "cc by", f"cc by nd( {_V}[1234]( [05])?)?"), ("cc-by-nd", "creative commons", f"creative commons attribution (no derivs|noderivs|no derivatives|noderivatives)( {_V}[1234]( [05])?)?"), ("cc-by", "cc by", f"cc by( {_V}[1234]( [05])?)?"), ("cc-by", "creative commons", f"creative commons attribution( {_V}[1234]( [05])?)?"),
    ("creative-commons", "creative commons", f"creative commons {_L}"),
)
#: (priority, confidence, before, after): what may stand around a name. A lower priority is better; None as confidence marks what takes a license back.
FORMS = (
    (0, None, "(not|never|no longer) ((licen[cs]ed|released|distributed|available|published|provided|covered) )?(under|by) (the )?(terms of )?(the )?", f"( {_L})?"),
    (1, 1.0, "spdx license identifier ", ""),
    (1, 0.95, "(licen[cs]ed|released|distributed|available|published|provided|shared|offered|covered|governed|redistributed|dual licen[cs]ed) (under|by|with) (the )?(terms (and conditions )?of )?(the )?", f"( {_L})?"),
    (2, 0.8, "under (the )?(terms (and conditions )?of )?(the )?", f"( {_L})?"),
    (3, 0.6, "", ""),
)
#: (label, keyword, words): sentences of the licenses' own texts and notices.
NOTICES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"), ("isc", "hereby granted", "permission to use copy modify (and|and or) distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"), ("apache-2", "apache", f"you may not use this file except in compliance with the {_L}.{{0,60}} apache org licenses {_L} 2 0"), ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it"), ("mpl-2", "mozilla", f"this source code form is subject to the terms of the mozilla public {_L}( {_V}2( 0)?)?"), ("bsl-1", "boost", f"distributed under the boost software {_L} {_V}1 0 see accompanying file"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"), ("public-domain", "public domain", "(dedicated|released|placed) (in|into|to) the public domain"), ("public-domain", "public domain", "(is|are) in the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to( public license)?"), ("zlib", "implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"), ("cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]"), ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]"), ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [05]"), ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [05]"), ("cc0-1", "creativecommons", "creativecommons org publicdomain zero 1 0"), ("proprietary", "proprietary", "(confidential and proprietary|proprietary and confidential)"), ("proprietary", "all rights", "all rights (are )?reserved"),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|use|distribution) of this (file|software|document|work).{0,40} prohibited"),
)


def padded(pattern: str) -> str:
    """The pattern where every word has a blank of its own on both sides, so that matches which follow each other share nothing."""
    return " " + pattern.replace(" ", "  ").replace(".{", "[^\\n]{") + " "


def _rules() -> list[Rule]:
    drafts = [(0, keyword, phrase, phrase, label, True, 0.9) for phrase, keyword, label in BASE_PHRASES]
    drafts += [(0, keyword, words, words, label, False, 0.9) for label, keyword, words in NOTICES]
    for priority, confidence, before, after in FORMS:
        drafts += [(priority, keyword, name, before + f"({name})" + after, label if confidence else None, False, confidence or 0.0) for label, keyword, name in NAMES]
    drafts.sort(key=lambda d: d[0])  # stable: within a priority as written
    return [Rule(i, p, padded(keyword), padded(needed), padded(pattern), label, base, confidence) for i, (p, keyword, needed, pattern, label, base, confidence) in enumerate(drafts)]


RULES = _rules()
