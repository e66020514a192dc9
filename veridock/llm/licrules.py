"""The license rules, in order: label, keyword, pattern over lower-case words that single blanks separate.

A rule is tried only where its keyword, one or more whole words, stands in the text. Rules of a level outrank those of the levels after it.
"""

from __future__ import annotations

#: Levels, and how much a detection of each says.
IDENTIFIER, TITLE, NAME, HINT = range(4)
STRENGTH = (1.0, 0.95, 0.8, 0.4)

#: Behind ``SPDX-License-Identifier:``.
IDENTIFIERS = (
    ("apache-2.0", r"apache 2 0"),
    ("apache-1.1", r"apache 1 1"),
    ("apache-1.0", r"apache 1 0"),
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("x11", r"x11"),
    ("isc", r"isc"),
    ("0bsd", r"0bsd"),
    ("bsd-1-clause", r"bsd 1 clause"),
    ("bsd-2-clause", r"bsd 2 clause( patent)?"),
    ("bsd-3-clause", r"bsd 3 clause( clear| lbnl)?"),
    ("bsd-4-clause", r"bsd 4 clause( uc)?"),
    ("gpl-1.0", r"gpl 1 0( only)?"),
    ("gpl-1.0-or-later", r"gpl 1 0 or later"),
    ("gpl-2.0", r"gpl 2 0( only)?"),
    ("gpl-2.0-or-later", r"gpl 2 0 or later"),
    ("gpl-3.0", r"gpl 3 0( only)?"),
    ("gpl-3.0-or-later", r"gpl 3 0 or later"),
    ("lgpl-2.0", r"lgpl 2 0( only)?"),
    ("lgpl-2.0-or-later", r"lgpl 2 0 or later"),
    ("lgpl-2.1", r"lgpl 2 1( only)?"),
    ("lgpl-2.1-or-later", r"lgpl 2 1 or later"),
    ("lgpl-3.0", r"lgpl 3 0( only)?"),
    ("lgpl-3.0-or-later", r"lgpl 3 0 or later"),
    ("agpl-1.0", r"agpl 1 0( only| or later)?"),
    ("agpl-3.0", r"agpl 3 0( only)?"),
    ("agpl-3.0-or-later", r"agpl 3 0 or later"),
    ("gfdl-1.1", r"gfdl 1 1( only| or later)?"),
    ("gfdl-1.2", r"gfdl 1 2( only| or later)?"),
    ("gfdl-1.3", r"gfdl 1 3( only| or later)?"),
    ("mpl-1.0", r"mpl 1 0"),
    ("mpl-1.1", r"mpl 1 1"),
    ("mpl-2.0", r"mpl 2 0( no copyleft exception)?"),
    ("epl-1.0", r"epl 1 0"),
    ("epl-2.0", r"epl 2 0"),
    ("eupl-1.1", r"eupl 1 1"),
    ("eupl-1.2", r"eupl 1 2"),
    ("cddl-1.0", r"cddl 1 0"),
    ("cddl-1.1", r"cddl 1 1"),
    ("cpl-1.0", r"cpl 1 0"),
    ("ipl-1.0", r"ipl 1 0"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("bsl-1.0", r"bsl 1 0"),
    ("busl-1.1", r"busl 1 1"),
    ("sspl-1.0", r"sspl 1 0"),
    ("elastic-2.0", r"elastic 2 0"),
    ("cc0-1.0", r"cc0 1 0"),
    ("cc-by-1.0", r"cc by 1 0"),
    ("cc-by-2.0", r"cc by 2 0"),
    ("cc-by-2.5", r"cc by 2 5"),
    ("cc-by-3.0", r"cc by 3 0"),
    ("cc-by-4.0", r"cc by 4 0"),
    ("cc-by-sa-2.0", r"cc by sa 2 0"),
    ("cc-by-sa-3.0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", r"cc by sa 4 0"),
    ("cc-by-nd-4.0", r"cc by nd (3 0|4 0)"),
    ("cc-by-nc-4.0", r"cc by nc (3 0|4 0)"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa (3 0|4 0)"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd (3 0|4 0)"),
    ("odbl-1.0", r"odbl 1 0"),
    ("odc-by-1.0", r"odc by 1 0"),
    ("pddl-1.0", r"pddl 1 0"),
    ("ofl-1.1", r"ofl 1 1( rfn| no rfn)?"),
    ("artistic-1.0", r"artistic 1 0( perl| cl8)?"),
    ("artistic-2.0", r"artistic 2 0"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("zlib", r"zlib"),
    ("libpng", r"libpng( 2 0)?"),
    ("python-2.0", r"(python|psf) 2 0( 1)?"),
    ("postgresql", r"postgresql"),
    ("php-3.01", r"php 3 0(1)?"),
    ("ruby", r"ruby"),
    ("ncsa", r"ncsa"),
    ("openssl", r"openssl( standalone)?"),
    ("afl-3.0", r"afl (1 1|1 2|2 0|2 1|3 0)"),
    ("osl-3.0", r"osl (1 0|1 1|2 0|2 1|3 0)"),
    ("ecl-2.0", r"ecl (1 0|2 0)"),
    ("upl-1.0", r"upl 1 0"),
    ("vim", r"vim"),
    ("qpl-1.0", r"qpl 1 0"),
    ("beerware", r"beerware"),
    ("curl", r"curl"),
    ("icu", r"(icu|unicode 3 0|unicode dfs 2016)"),
    ("bzip2-1.0.6", r"bzip2 1 0 (5|6)"),
    ("mulan-psl-2.0", r"mulanpsl (1|2) 0"),
    ("blueoak-1.0.0", r"blueoak 1 0 0"),
)

#: Titles with their version, addresses, and sentences that only one license has.
TITLES = (
    ("apache-2.0", "apache", r"apache (software )?licen[cs]e (version |v )?2( 0)?"),
    ("apache-2.0", "apache", r"asf licen[cs]e (version |v )?2( 0)?"),
    ("apache-1.1", "apache", r"apache (software )?licen[cs]e (version |v )?1 1"),
    ("apache-1.0", "apache", r"apache (software )?licen[cs]e (version |v )?1 0"),
    ("apache-2.0", "apache org", r"(www )?apache org licen[cs]es licen[cs]e 2 0( txt| html)?"),
    ("apache-2.0", "distributed on an", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-1.0", "general public", r"(gnu )?general public licen[cs]e (version |v )?1( 0)?"),
    ("gpl-2.0", "general public", r"(gnu )?general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?2( 0)?"),
    ("gpl-3.0", "general public", r"(gnu )?general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?3( 0)?"),
    ("gpl-2.0-or-later", "general public", r"(gnu )?general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?2( 0)? (of the licen[cs]e )?or (at your option )?any later version"),
    ("gpl-3.0-or-later", "general public", r"(gnu )?general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?3( 0)? (of the licen[cs]e )?or (at your option )?any later version"),
    ("gpl-2.0", "gpl", r"(gnu )?gpl (version |v )?(v)?2( 0)?( only)?"),
    ("gpl-3.0", "gpl", r"(gnu )?gpl (version |v )?(v)?3( 0)?( only)?"),
    ("gpl-2.0-or-later", "gpl", r"(gnu )?gpl (version |v )?(v)?2( 0)? or (later|newer)"),
    ("gpl-3.0-or-later", "gpl", r"(gnu )?gpl (version |v )?(v)?3( 0)? or (later|newer)"),
    ("gpl-2.0", "gplv2", r"(gnu )?gplv2( 0)?( only)?"),
    ("gpl-3.0", "gplv3", r"(gnu )?gplv3( 0)?( only)?"),
    ("gpl-2.0-or-later", "gplv2", r"(gnu )?gplv2( 0)? or (later|newer)"),
    ("gpl-3.0-or-later", "gplv3", r"(gnu )?gplv3( 0)? or (later|newer)"),
    ("gpl-2.0", "gnu org", r"(www )?gnu org licen[cs]es (old licen[cs]es )?gpl 2 0( html| txt)?"),
    ("gpl-3.0", "gnu org", r"(www )?gnu org licen[cs]es gpl 3 0( html| txt)?"),
    ("lgpl-2.0", "library general public", r"(gnu )?library general public licen[cs]e (version |v )?2( 0)?"),
    ("lgpl-2.1", "lesser general public", r"(gnu )?lesser general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?2 1"),
    ("lgpl-3.0", "lesser general public", r"(gnu )?lesser general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?3( 0)?"),
    ("lgpl-2.1-or-later", "lesser general public", r"(gnu )?lesser general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?2 1 (of the licen[cs]e )?or (at your option )?any later version"),
    ("lgpl-2.1", "lgpl", r"(gnu )?lgpl (version |v )?(v)?2 1( only)?"),
    ("lgpl-3.0", "lgpl", r"(gnu )?lgpl (version |v )?(v)?3( 0)?( only)?"),
    ("lgpl-2.1", "lgplv2", r"(gnu )?lgplv2 1( only)?"),
    ("lgpl-3.0", "lgplv3", r"(gnu )?lgplv3( 0)?( only)?"),
    ("lgpl-2.1", "gnu org", r"(www )?gnu org licen[cs]es (old licen[cs]es )?lgpl 2 1( html| txt)?"),
    ("lgpl-3.0", "gnu org", r"(www )?gnu org licen[cs]es lgpl 3 0( html| txt)?"),
    ("agpl-3.0", "affero", r"(gnu )?affero general public licen[cs]e (as published by the free software foundation )?(either )?(version |v )?3( 0)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (version |v )?1( 0)?"),
    ("agpl-3.0", "agpl", r"(gnu )?agpl (version |v )?(v)?3( 0)?"),
    ("agpl-3.0", "agplv3", r"(gnu )?agplv3( 0)?"),
    ("agpl-3.0", "gnu org", r"(www )?gnu org licen[cs]es agpl 3 0( html| txt)?"),
    ("gfdl-1.2", "free documentation", r"(gnu )?free documentation licen[cs]e (version |v )?1 2"),
    ("gfdl-1.3", "free documentation", r"(gnu )?free documentation licen[cs]e (version |v )?1 3"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "opensource org", r"(www )?opensource org licen[cs]es? mit( licen[cs]e)?"),
    ("mit-0", "no attribution", r"mit no attribution( licen[cs]e)?"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause", r"(bsd )?zero clause( bsd)?( licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(bsd (2|two) clause|(2|two) clause bsd|simplified bsd)( style)?( licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(bsd (3|three) clause|(3|three) clause bsd|new bsd|modified bsd|revised bsd)( style)?( licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(bsd (4|four) clause|(4|four) clause bsd|original bsd|old bsd)( style)?( licen[cs]e)?"),
    ("bsd-2-clause", "opensource org", r"(www )?opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", r"(www )?opensource org licen[cs]es? bsd 3 clause"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,200} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (version |v )?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (version |v )?2( 0)?"),
    ("mpl-2.0", "mozilla org", r"(www )?mozilla org (mpl|en us mpl) 2 0"),
    ("mpl-1.1", "mozilla org", r"(www )?mozilla org mpl mpl 1 1( html| txt)?"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e (version |v )?2( 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (version |v )?1( 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (version |v )?2( 0)?"),
    ("epl-1.0", "eclipse org", r"(www )?eclipse org (legal|org documents) epl v10( html)?"),
    ("epl-2.0", "eclipse org", r"(www )?eclipse org (legal|org documents) epl (v20|2 0)( html)?"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e (version |v )?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e (version |v )?1 2"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e (cddl )?(version |v )?1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (cddl )?(version |v )?1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e (version |v )?1 0"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e (version |v )?1 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e( ms pl)?"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e( ms rl)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e (version |v )?1( 0)?"),
    ("bsl-1.0", "boost org", r"(www )?boost org licen[cs]e 1 0( txt)?"),
    ("busl-1.1", "business source", r"business source licen[cs]e (version |v )?1( 1)?"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e (version |v )?1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e (version |v )?2( 0)?"),
    ("cc0-1.0", "cc0", r"(creative commons )?cc0( 1 0)?( universal)?( public domain dedication)?"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "creativecommons org", r"creativecommons org licen[cs]es by 4 0"),
    ("cc-by-3.0", "creativecommons org", r"creativecommons org licen[cs]es by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licen[cs]es by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licen[cs]es by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", r"creativecommons org licen[cs]es by nc (3|4) 0"),
    ("cc-by-nd-4.0", "creativecommons org", r"creativecommons org licen[cs]es by nd (3|4) 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", r"creativecommons org licen[cs]es by nc sa (3|4) 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", r"creativecommons org licen[cs]es by nc nd (3|4) 0"),
    ("cc-by-2.0", "cc by", r"(creative commons )?cc by 2 0"),
    ("cc-by-2.5", "cc by", r"(creative commons )?cc by 2 5"),
    ("cc-by-3.0", "cc by", r"(creative commons )?cc by 3 0"),
    ("cc-by-4.0", "cc by", r"(creative commons )?cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"(creative commons )?cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"(creative commons )?cc by sa 4 0"),
    ("cc-by-nc-3.0", "cc by nc", r"(creative commons )?cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"(creative commons )?cc by nc 4 0"),
    ("cc-by-nd-3.0", "cc by nd", r"(creative commons )?cc by nd 3 0"),
    ("cc-by-nd-4.0", "cc by nd", r"(creative commons )?cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"(creative commons )?cc by nc sa (3|4) 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"(creative commons )?cc by nc nd (3|4) 0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution (4 0|international)( international)?( public)?( licen[cs]e)?"),
    ("cc-by-3.0", "creative commons", r"creative commons attribution 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share( )?alike 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-sa-3.0", "creative commons", r"creative commons attribution share( )?alike 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non( )?commercial 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nd-4.0", "creative commons", r"creative commons attribution no( )?deriv(ative)?s 4 0( international)?( licen[cs]e)?"),
    ("odbl-1.0", "open database", r"open database licen[cs]e( odbl)?( (version |v )?1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e( (version |v )?1 0)?"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication( and licen[cs]e)?( (version |v )?1 0)?"),
    ("ofl-1.1", "open font", r"(sil )?open font licen[cs]e (version |v )?1 1"),
    ("ofl-1.1", "sil org", r"scripts sil org ofl"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (version |v )?1( 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (version |v )?2( 0)?"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"(www )?unlicense org"),
    ("wtfpl", "do what the", r"do what the f\S{1,5} you want to public licen[cs]e"),
    ("zlib", "zlib", r"zlib( libpng)? licen[cs]e"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("python-2.0", "python software foundation", r"python software foundation licen[cs]e (version |v )?2( 0)?"),
    ("php-3.01", "php", r"php licen[cs]e (version |v )?3 01?"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa open source licen[cs]e"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e (version |v )?[123] [0-9]"),
    ("osl-3.0", "open software", r"open software licen[cs]e (version |v )?[123] [0-9]"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e (version |v )?[12] 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e (version |v )?1 0"),
    ("qpl-1.0", "q public", r"q public licen[cs]e (version |v )?1 0"),
    ("beerware", "beerware", r"(the )?beerware licen[cs]e( revision 42)?"),
    ("beerware", "beer ware", r"(the )?beer ware licen[cs]e( revision 42)?"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[cs]e (version |v )?[12]( 0)?"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e 1 0 0"),
    ("openrail", "openrail", r"(creativeml |bigscience )?openrail( m)?( licen[cs]e)?"),
    ("openrail", "open rail", r"(creativeml |bigscience )?open rail( m)?( licen[cs]e)?"),
    ("llama-community", "community license", r"llama [234]( [0-9])? community licen[cs]e( agreement)?"),
    ("etalab-2.0", "licence ouverte", r"licence ouverte( open licence)?( (version |v )?[12] 0)?"),
    ("ogl-3.0", "open government", r"open government licen[cs]e( (version |v )?[123] 0)?"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland (namensnennung|zero)( (version )?2 0)?"),
)

#: Families without a version.
NAMES = (
    ("apache", "apache", r"apache (software )?licen[cs]e"),
    ("mit", "mit", r"mit( x11)?( style| expat)? licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit", "massachusetts", r"massachusetts institute of technology licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("bsd", "bsd", r"(berkeley software distribution|bsd)( style| type)? licen[cs]e"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "general public", r"(gnu )?general public licen[cs]e"),
    ("gpl", "gpl", r"(gnu )?gpl"),
    ("gpl", "gnu org", r"(www )?gnu org (licen[cs]es|copyleft) gpl( html| txt)?"),
    ("lgpl", "lesser general public", r"(gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general public", r"(gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", r"(gnu )?lgpl"),
    ("agpl", "affero", r"(gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", r"(gnu )?agpl"),
    ("gfdl", "free documentation", r"(gnu )?free documentation licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("bsl", "boost", r"boost software licen[cs]e"),
    ("cc-by-nc-nd", "cc by nc nd", r"(creative commons )?cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa", r"(creative commons )?cc by nc sa"),
    ("cc-by-nc", "cc by nc", r"(creative commons )?cc by nc"),
    ("cc-by-nd", "cc by nd", r"(creative commons )?cc by nd"),
    ("cc-by-sa", "cc by sa", r"(creative commons )?cc by sa"),
    ("cc-by", "cc by", r"(creative commons )?cc by"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share( )?alike( licen[cs]e)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non( )?commercial( licen[cs]e)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no( )?deriv(ative)?s( licen[cs]e)?"),
    ("cc-by", "creative commons", r"creative commons attribution( licen[cs]e)?"),
    ("creative-commons", "creative commons", r"creative commons( licen[cs]e| zero)?"),
    ("creative-commons", "creativecommons org", r"creativecommons org licen[cs]es"),
    ("ofl", "open font", r"(sil )?open font licen[cs]e"),
    ("artistic", "artistic", r"(perl )?artistic licen[cs]e"),
    ("unlicense", "unlicense", r"(the )?unlicense"),
    ("python", "python", r"python (software foundation )?licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("php", "php", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby( s)? licen[cs]e"),
    ("openssl", "openssl", r"openssl( ssleay)? licen[cs]e"),
    ("sspl", "server side", r"server side public licen[cs]e"),
    ("elastic", "elastic", r"elastic licen[cs]e"),
    ("busl", "business source", r"business source licen[cs]e"),
    ("odbl", "odbl", r"odbl"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("public-domain", "public domain", r"(released |placed |dedicated )?(in|into|to) the public domain"),
    ("public-domain", "gemeinfrei", r"gemeinfrei"),
    ("public-domain", "gemeinfreie", r"gemeinfreie (werke?|inhalte?|texte?)"),
    ("public-domain", "domaine public", r"(dans le )?domaine public"),
    ("public-domain", "dominio público", r"(de )?dominio público"),
    ("public-domain", "no rights reserved", r"no rights reserved"),
    ("some-reserved", "some rights reserved", r"some rights reserved"),
    ("reserved", "all rights reserved", r"all rights( are)? reserved"),
    ("reserved", "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("reserved", "droits réservés", r"tous droits réservés"),
    ("reserved", "derechos reservados", r"todos los derechos reservados"),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (copying|reproduction|use|distribution)( or distribution)? of this (file|software|document|material)"),
    ("proprietary", "end user", r"end user licen[cs]e agreement"),
)

#: What only says that there is a license.
HINTS = (
    ("license-notice", "licensed under", r"(dual )?licensed under( the)?( terms of)?( the)?"),
    ("license-notice", "released under", r"released under( the)?( terms of)?( the)? (\S+ ){0,6}licen[cs]e"),
    ("license-notice", "distributed under", r"distributed under( the)?( terms of)?( the)? (\S+ ){0,6}licen[cs]e"),
    ("license-notice", "available under", r"(made )?available under( the)?( terms of)?( the)? (\S+ ){0,6}licen[cs]e"),
    ("license-notice", "subject to the", r"subject to the (terms|conditions)( and conditions)? of (the |this )?(\S+ ){0,6}licen[cs]e"),
    ("license-notice", "see the license", r"see the (file )?licen[cs]e( file)?( for)?( more)?( details)?"),
    ("license-notice", "copy of the license", r"(you may obtain|you should have received) a copy of the (\S+ ){0,5}licen[cs]e"),
    ("license-notice", "under license", r"(used|published|reprinted) under licen[cs]e"),
    ("license-notice", "lizenziert", r"lizenziert unter( der| den)?"),
    ("license-notice", "sous licence", r"(publiée? |distribuée? |placée? )?sous licence"),
    ("license-notice", "bajo licencia", r"(publicado |distribuido )?bajo (la )?licencia"),
    ("license-notice", "spdx license identifier", r"spdx license identifier"),
    ("license-notice", "licence", r"(under|by) (a|this) licence"),
    ("license-notice", "license", r"(under|by) (a|this) license"),
    ("copyright", "copyright", r"copyright( c)?( ©)?( 19[0-9]{2}| 20[0-9]{2})+"),
    ("copyright", "copyright", r"copyright( notice| holders?| owners?)"),
    ("copyright", "copyrighted", r"copyrighted( by| material| work)?"),
    ("copyright", "urheberrecht", r"(das )?urheberrecht"),
    ("copyright", "urheberrechtlich", r"urheberrechtlich geschützt"),
    ("copyright", "droit d auteur", r"(le )?droit d auteur"),
    ("copyright", "droits d auteur", r"(les )?droits d auteur"),
    ("copyright", "derechos de autor", r"derechos de autor"),
    ("no-warranty", "without warranty", r"without (any )?warranty( of any kind)?"),
    ("no-warranty", "without warranties", r"without warranties( or conditions)? of any kind"),
    ("no-warranty", "provided as is", r"(is )?provided as is"),
    ("patent-grant", "patent", r"(a )?patent (licen[cs]e|grant)"),
    ("redistribution", "redistributed", r"(may|can) be (freely )?redistributed"),
    ("redistribution", "copied and distributed", r"(may|can) be (freely )?copied and distributed"),
    ("non-commercial", "noncommercial", r"(for )?noncommercial (use|purposes)( only)?"),
    ("non-commercial", "non commercial", r"(for )?non commercial (use|purposes)( only)?"),
    ("attribution", "attribution", r"attribution (is )?required"),
    ("permission", "permission", r"(used|reprinted|reproduced) (with|by) permission"),
    ("permission", "permission", r"without (the )?(prior |express )?(written )?permission"),
)
