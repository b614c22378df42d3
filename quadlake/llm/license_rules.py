"""Signature rules of the license scan, in order.

A line is: label, priority, confidence, expression. Expressions are over lower-cased words joined by single
spaces; a star stands before the rule's keyword, one word that every match has. LIC stands for both
spellings of the noun, VER for the words before a version number, UNDER for what often leads to a name.
"""

RULES = r"""
# Identifiers
mit 9 1.0 *spdx LIC identifier mit
mit-0 9 1.0 *spdx LIC identifier mit 0
x11 9 1.0 *spdx LIC identifier x11
isc 9 1.0 *spdx LIC identifier isc
0bsd 9 1.0 *spdx LIC identifier 0bsd
bsd-2-clause 9 1.0 *spdx LIC identifier bsd 2 clause
bsd-3-clause 9 1.0 *spdx LIC identifier bsd 3 clause
bsd-4-clause 9 1.0 *spdx LIC identifier bsd 4 clause
apache-1.1 9 1.0 *spdx LIC identifier apache 1 1
apache-2.0 9 1.0 *spdx LIC identifier apache 2 0
gpl-2.0 9 1.0 *spdx LIC identifier gpl 2 0(?: only| or later)?
gpl-3.0 9 1.0 *spdx LIC identifier gpl 3 0(?: only| or later)?
lgpl-2.1 9 1.0 *spdx LIC identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 9 1.0 *spdx LIC identifier lgpl 3 0(?: only| or later)?
agpl-3.0 9 1.0 *spdx LIC identifier agpl 3 0(?: only| or later)?
mpl-1.1 9 1.0 *spdx LIC identifier mpl 1 1
mpl-2.0 9 1.0 *spdx LIC identifier mpl 2 0
epl-1.0 9 1.0 *spdx LIC identifier epl 1 0
epl-2.0 9 1.0 *spdx LIC identifier epl 2 0
cddl-1.0 9 1.0 *spdx LIC identifier cddl 1 0
eupl-1.2 9 1.0 *spdx LIC identifier eupl 1 2
osl-3.0 9 1.0 *spdx LIC identifier osl 3 0
artistic-2.0 9 1.0 *spdx LIC identifier artistic 2 0
bsl-1.0 9 1.0 *spdx LIC identifier bsl 1 0
zlib 9 1.0 *spdx LIC identifier zlib
unlicense 9 1.0 *spdx LIC identifier unlicense
wtfpl 9 1.0 *spdx LIC identifier wtfpl
cc0 9 1.0 *spdx LIC identifier cc0 1 0
cc-by 9 1.0 *spdx LIC identifier cc by [1-4] [05]
cc-by-sa 9 1.0 *spdx LIC identifier cc by sa [1-4] [05]
cc-by-nc 9 1.0 *spdx LIC identifier cc by nc [1-4] [05]
cc-by-nd 9 1.0 *spdx LIC identifier cc by nd [1-4] [05]
cc-by-nc-sa 9 1.0 *spdx LIC identifier cc by nc sa [1-4] [05]
cc-by-nc-nd 9 1.0 *spdx LIC identifier cc by nc nd [1-4] [05]
ofl-1.1 9 1.0 *spdx LIC identifier ofl 1 1
postgresql 9 1.0 *spdx LIC identifier postgresql
python 9 1.0 *spdx LIC identifier (?:python|psf) 2 0(?: 1)?
unknown-spdx 1 0.4 *spdx LIC identifier

# Sentences of whole texts
mit 8 0.95 permission is hereby granted free of charge to any person *obtaining a copy
mit 7 0.9 to use copy modify merge publish distribute *sublicense and or sell copies
mit 7 0.9 the above copyright notice and this permission notice shall be included in all copies or *substantial portions
x11 7 0.85 notice the names? of (?:[^ ]+ ){1,6}shall not be used in *advertising
isc 8 0.95 permission to use copy modify and or distribute this software for any purpose with or without *fee
isc 7 0.9 permission to use copy modify and distribute this software (?:[^ ]+ ){0,4}for any purpose with or without *fee
bsd 8 0.95 *redistribution and use in source and binary forms with or without modification are permitted
bsd 7 0.85 *redistributions of source code must retain the above copyright notice
bsd 7 0.85 *redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 7 0.9 neither the names? of (?:[^ ]+ ){1,10}may be used to *endorse or promote products
bsd-4-clause 7 0.9 all *advertising materials mentioning features or use of this software
zlib 8 0.95 the origin of this software must not be *misrepresented
zlib 7 0.9 altered source versions must be plainly *marked as such
zlib 7 0.85 this software is provided as is without any express or *implied warranty in no event
bsl-1.0 7 0.9 permission is hereby granted free of charge to any person or *organization obtaining a copy
apache-2.0 8 0.95 you may not use this file except in *compliance with the license
apache-2.0 7 0.9 www *apache org licenses license 2 0
apache 6 0.7 *apache org licenses
apache-1.1 7 0.85 this product includes software developed by the *apache (?:software foundation|group)
gpl 7 0.9 under the terms of the gnu *general public LIC as published by the free software foundation
gpl-2.0 8 0.95 gnu *general public LIC as published by the free software foundation either version 2
gpl-3.0 8 0.95 gnu *general public LIC as published by the free software foundation either version 3
lgpl 8 0.95 gnu *lesser general public LIC as published by the free software foundation
lgpl 8 0.95 gnu *library general public LIC as published by the free software foundation
agpl 8 0.95 gnu *affero general public LIC as published by the free software foundation
gpl 6 0.7 www *gnu org licenses gpl
lgpl 6 0.7 www *gnu org licenses lgpl
agpl 6 0.7 www *gnu org licenses agpl
gpl 6 0.6 you should have received a copy of the gnu *general public LIC
mpl-2.0 8 0.95 this source code form is subject to the terms of the *mozilla public LIC
mpl-2.0 7 0.9 *mozilla org mpl 2 0
mpl-1.1 7 0.9 *mozilla org mpl mpl 1 1
epl-1.0 7 0.9 *eclipse org legal epl v10
epl-2.0 7 0.9 *eclipse org legal epl (?:2 0|v20)
unlicense 8 0.95 free and *unencumbered software released into the public domain
unlicense 6 0.8 *unlicense org
wtfpl 8 0.95 do what the *fuck you want to public LIC
cc0 7 0.9 *creativecommons org publicdomain zero 1 0
cc-by 7 0.9 *creativecommons org licenses by [1-4] [05]
cc-by-sa 7 0.9 *creativecommons org licenses by sa [1-4] [05]
cc-by-nc 7 0.9 *creativecommons org licenses by nc [1-4] [05]
cc-by-nd 7 0.9 *creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa 7 0.9 *creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd 7 0.9 *creativecommons org licenses by nc nd [1-4] [05]
public-domain 7 0.85 *creativecommons org publicdomain mark 1 0
ofl-1.1 7 0.9 *scripts sil org ofl
postgresql 7 0.9 permission to use copy modify and distribute this software and its *documentation for any purpose without fee
json 7 0.9 the software shall be used for good not *evil
beerware 7 0.9 you can buy me a *beer in return

# MIT and its relatives
mit 5 0.95 (?:licensed|released|distributed|available|published|provided|offered) under (?:the (?:terms|conditions) of )?(?:the |an )?*mit(?: x11| expat)?(?: LIC)?
mit 5 0.9 (?:under|subject to) the (?:terms|conditions) of the *mit LIC
mit 4 0.85 UNDER(?:the |an )?*mit(?: x11| expat| style)? LIC(?: agreement)?
mit 3 0.6 LIC (?:is )?*mit
mit 3 0.6 *mit licensed
mit-0 5 0.9 UNDER(?:the )?*mit (?:0|no attribution)(?: LIC)?
x11 5 0.9 (?:licensed|released|distributed|available) under (?:the )?*x11(?: LIC)?
x11 4 0.85 UNDER(?:the )?*x11 LIC
mit 4 0.85 UNDER(?:the )?*expat LIC
isc 5 0.95 (?:licensed|released|distributed|available) under (?:the )?*isc(?: LIC)?
isc 4 0.85 UNDER(?:the )?*isc LIC
isc 3 0.6 LIC (?:is )?*isc

# BSD
bsd 5 0.9 (?:licensed|released|distributed|available|published|provided) under (?:the (?:terms|conditions) of )?(?:the |a )?*bsd(?: style)?(?: LIC)?
bsd 4 0.8 UNDER(?:the |a )?*bsd(?: style| type)? LIC
bsd 3 0.6 LIC (?:is )?*bsd
bsd 3 0.6 *bsd licensed
0bsd 5 0.9 UNDER(?:the )?*0bsd(?: LIC)?
0bsd 5 0.9 UNDER(?:the )?(?:zero clause|0 clause) *bsd(?: LIC)?
0bsd 5 0.9 UNDER(?:the )?*bsd (?:zero clause|0 clause)(?: LIC)?
bsd-2-clause 5 0.9 UNDER(?:the )?(?:simplified|2 clause|two clause) *bsd(?: LIC)?
bsd-2-clause 5 0.9 UNDER(?:the )?*bsd (?:2|two) clause(?: LIC)?
bsd-2-clause 4 0.8 UNDER(?:the )?*freebsd LIC
bsd-3-clause 5 0.9 UNDER(?:the )?(?:new|modified|revised|3 clause|three clause) *bsd(?: LIC)?
bsd-3-clause 5 0.9 UNDER(?:the )?*bsd (?:3|three) clause(?: LIC)?
bsd-4-clause 5 0.9 UNDER(?:the )?(?:original|old|4 clause|four clause) *bsd(?: LIC)?
bsd-4-clause 5 0.9 UNDER(?:the )?*bsd (?:4|four) clause(?: LIC)?

# Apache
apache 5 0.9 (?:licensed|released|distributed|available|published|provided) under (?:the (?:terms|conditions) of )?(?:the )?*apache(?: software)?(?: LIC)?
apache 4 0.85 UNDER(?:the |an )?*apache(?: software| style)? LIC
apache-2.0 6 0.95 UNDER(?:the )?*apache(?: software)? LICVER 2(?: 0)?
apache-2.0 5 0.85 UNDER(?:the )?*apache 2(?: 0)?(?: LIC)?
apache-2.0 4 0.7 *asl 2(?: 0)?
apache-1.1 6 0.95 UNDER(?:the )?*apache(?: software)? LICVER 1 1
apache-1.0 6 0.95 UNDER(?:the )?*apache(?: software)? LICVER 1 0
apache 3 0.6 LIC (?:is )?*apache

# GNU
gpl 4 0.85 UNDER(?:the )?(?:gnu )?*general public LIC
gpl 4 0.8 UNDER(?:the )?(?:gnu )?*gpl(?: LIC)?
gpl-1.0 6 0.9 UNDER(?:the )?(?:gnu )?*general public LICVER 1(?: 0)?
gpl-2.0 6 0.95 UNDER(?:the )?(?:gnu )?*general public LICVER 2(?: 0)?
gpl-2.0 6 0.9 UNDER(?:the )?(?:gnu )?*gplVER 2(?: 0)?
gpl-2.0 6 0.9 UNDER(?:the )?(?:gnu )?*gplv2
gpl-3.0 6 0.95 UNDER(?:the )?(?:gnu )?*general public LICVER 3(?: 0)?
gpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*gplVER 3(?: 0)?
gpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*gplv3
gpl 5 0.9 (?:licensed|released|distributed|available|published|provided) under (?:the (?:terms|conditions) of )?(?:the )?(?:gnu )?*gpl(?: LIC)?
gpl 5 0.85 (?:licensed|released|distributed|available|published|provided) under (?:the (?:terms|conditions) of )?(?:the )?gnu *general public LIC
lgpl 6 0.9 UNDER(?:the )?(?:gnu )?*lesser general public LIC
lgpl 6 0.9 UNDER(?:the )?(?:gnu )?*library general public LIC
lgpl 4 0.8 UNDER(?:the )?(?:gnu )?*lgpl(?: LIC)?
lgpl-2.0 7 0.95 UNDER(?:the )?(?:gnu )?*library general public LICVER 2(?: 0)?
lgpl-2.1 7 0.95 UNDER(?:the )?(?:gnu )?*lesser general public LICVER 2 1
lgpl-2.1 6 0.9 UNDER(?:the )?(?:gnu )?*lgplVER 2 1
lgpl-2.1 6 0.9 UNDER(?:the )?(?:gnu )?*lgplv2 1
lgpl-3.0 7 0.95 UNDER(?:the )?(?:gnu )?*lesser general public LICVER 3(?: 0)?
lgpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*lgplVER 3(?: 0)?
lgpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*lgplv3
agpl 6 0.9 UNDER(?:the )?(?:gnu )?*affero general public LIC
agpl 4 0.8 UNDER(?:the )?(?:gnu )?*agpl(?: LIC)?
agpl-3.0 7 0.95 UNDER(?:the )?(?:gnu )?*affero general public LICVER 3(?: 0)?
agpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*agplVER 3(?: 0)?
agpl-3.0 6 0.9 UNDER(?:the )?(?:gnu )?*agplv3
gfdl 6 0.9 UNDER(?:the )?gnu free *documentation LIC
gfdl 4 0.8 UNDER(?:the )?*gfdl
gpl 6 0.7 with the (?:classpath|linking) *exception
copyleft 1 0.5 *copyleft

# Mozilla, Eclipse and others of files and patents
mpl 5 0.85 UNDER(?:the )?*mozilla public LIC
mpl-1.0 6 0.9 UNDER(?:the )?*mozilla public LICVER 1 0
mpl-1.1 6 0.95 UNDER(?:the )?*mozilla public LICVER 1 1
mpl-2.0 6 0.95 UNDER(?:the )?*mozilla public LICVER 2(?: 0)?
mpl 4 0.75 (?:under|LIC) (?:is |the )?*mpl
mpl-1.1 6 0.9 UNDER(?:the )?*mplVER 1 1
mpl-2.0 6 0.9 UNDER(?:the )?*mplVER 2(?: 0)?
epl 5 0.85 UNDER(?:the )?*eclipse public LIC
epl-1.0 6 0.95 UNDER(?:the )?*eclipse public LICVER 1(?: 0)?
epl-2.0 6 0.95 UNDER(?:the )?*eclipse public LICVER 2(?: 0)?
edl 5 0.85 UNDER(?:the )?*eclipse distribution LIC(?:VER 1 0)?
cpl 5 0.85 UNDER(?:the )?common public *LIC(?:VER 1 0)?
cpal 6 0.9 UNDER(?:the )?common public *attribution LIC
ipl 6 0.9 UNDER(?:the )?*ibm public LIC
spl 6 0.9 UNDER(?:the )?*sun public LIC
npl 6 0.9 UNDER(?:the )?*netscape public LIC
cddl 6 0.9 UNDER(?:the )?common development and *distribution LIC
cddl-1.0 7 0.95 UNDER(?:the )?common development and *distribution LICVER 1 0
cddl-1.1 7 0.95 UNDER(?:the )?common development and *distribution LICVER 1 1
cddl 4 0.75 UNDER(?:the )?*cddl
eupl 6 0.9 UNDER(?:the )?european union public *LIC
eupl-1.1 7 0.95 UNDER(?:the )?european union public *LICVER 1 1
eupl-1.2 7 0.95 UNDER(?:the )?european union public *LICVER 1 2
eupl 4 0.75 UNDER(?:the )?*eupl
cecill 5 0.85 UNDER(?:the )?*cecill(?: [abc])?(?: LIC)?
qpl 6 0.9 UNDER(?:the )?q public *LIC
osl 5 0.85 UNDER(?:the )?open software *LIC
osl-3.0 6 0.95 UNDER(?:the )?open software *LICVER 3 0
afl 6 0.9 UNDER(?:the )?academic free *LIC
afl-3.0 7 0.95 UNDER(?:the )?academic free *LICVER 3 0
rpl 6 0.9 UNDER(?:the )?*reciprocal public LIC
ms-pl 6 0.9 UNDER(?:the )?*microsoft public LIC
ms-rl 6 0.9 UNDER(?:the )?*microsoft reciprocal LIC
apsl 6 0.9 UNDER(?:the )?apple public *source LIC
nasa 6 0.9 UNDER(?:the )?*nasa open source agreement
upl 6 0.9 UNDER(?:the )?universal *permissive LIC
mulan 6 0.9 UNDER(?:the )?*mulan permissive software LIC

# Languages, libraries and fonts
artistic 5 0.85 UNDER(?:the )?(?:perl )?*artistic LIC
artistic-1.0 6 0.95 UNDER(?:the )?(?:perl )?*artistic LICVER 1(?: 0)?
artistic-2.0 6 0.95 UNDER(?:the )?(?:perl )?*artistic LICVER 2(?: 0)?
perl 5 0.8 same terms as *perl itself
bsl-1.0 6 0.9 UNDER(?:the )?*boost software LIC(?:VER 1 0)?
zlib 5 0.85 UNDER(?:the )?*zlib(?: libpng)? LIC
zlib 4 0.7 (?:licensed|released|distributed) under (?:the )?*zlib
libpng 5 0.85 UNDER(?:the )?*libpng LIC
python 5 0.85 UNDER(?:the )?*python(?: software foundation)? LIC(?:VER 2)?
python 4 0.75 UNDER(?:the )?*psf LIC
ruby 5 0.8 UNDER(?:the )?*ruby LIC
php 5 0.85 UNDER(?:the )?*php LIC
php-3.01 6 0.95 UNDER(?:the )?*php LICVER 3 01
openssl 5 0.85 UNDER(?:the )?*openssl LIC
postgresql 5 0.85 UNDER(?:the )?*postgresql LIC
curl 5 0.85 UNDER(?:the )?*curl LIC
vim 5 0.85 UNDER(?:the )?*vim LIC
tcl 5 0.8 UNDER(?:the )?*tcl(?: tk)? LIC
ntp 5 0.8 UNDER(?:the )?*ntp LIC
ncsa 5 0.85 UNDER(?:the )?(?:university of illinois )?*ncsa(?: open source)? LIC
w3c 5 0.85 UNDER(?:the )?*w3c (?:software|document)(?: notice and)? LIC
unicode 5 0.85 UNDER(?:the )?*unicode(?: data files and software)? LIC
icu 5 0.85 UNDER(?:the )?*icu LIC
json 5 0.8 UNDER(?:the )?*json LIC
latex 6 0.9 UNDER(?:the )?*latex project public LIC
lppl 5 0.85 UNDER(?:the )?*lppl
ofl 6 0.9 UNDER(?:the )?(?:sil )?open *font LIC
ofl-1.1 7 0.95 UNDER(?:the )?(?:sil )?open *font LICVER 1 1
ubuntu-font 6 0.9 UNDER(?:the )?*ubuntu font LIC
bitstream-vera 5 0.8 UNDER(?:the )?bitstream *vera
wtfpl 5 0.9 UNDER(?:the )?*wtfpl(?: LIC)?
unlicense 5 0.9 UNDER(?:the )?*unlicense
beerware 5 0.85 UNDER(?:the )?beer ware *LIC
beerware 5 0.85 UNDER(?:the )?*beerware(?: LIC)?

# Works, data and models
cc0 6 0.9 UNDER(?:the )?*cc0(?: 1 0)?(?: universal)?
cc0 6 0.9 UNDERcreative *commons zero(?: 1 0)?
cc 3 0.5 creative *commons(?: LIC)?
cc-by 5 0.9 UNDER(?:a |the )?creative *commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?LIC)?
cc-by-sa 6 0.95 UNDER(?:a |the )?creative *commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?LIC)?
cc-by-nc 6 0.95 UNDER(?:a |the )?creative *commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?LIC)?
cc-by-nd 6 0.95 UNDER(?:a |the )?creative *commons attribution no ?derivatives?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?LIC)?
cc-by-nc-sa 7 0.95 UNDER(?:a |the )?creative *commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:public )?LIC)?
cc-by-nc-nd 7 0.95 UNDER(?:a |the )?creative *commons attribution non ?commercial no ?derivatives?(?: [1-4] [05])?(?: (?:public )?LIC)?
cc-by 5 0.9 UNDER(?:a |the )?*cc by(?: [1-4] [05])?(?: LIC)?
cc-by-sa 6 0.95 UNDER(?:a |the )?*cc by sa(?: [1-4] [05])?(?: LIC)?
cc-by-nc 6 0.95 UNDER(?:a |the )?*cc by nc(?: [1-4] [05])?(?: LIC)?
cc-by-nd 6 0.95 UNDER(?:a |the )?*cc by nd(?: [1-4] [05])?(?: LIC)?
cc-by-nc-sa 7 0.95 UNDER(?:a |the )?*cc by nc sa(?: [1-4] [05])?(?: LIC)?
cc-by-nc-nd 7 0.95 UNDER(?:a |the )?*cc by nc nd(?: [1-4] [05])?(?: LIC)?
odbl 6 0.9 UNDER(?:the )?open (?:data commons open )?*database LIC
odbl 5 0.85 UNDER(?:the )?*odbl(?: 1 0)?
odc-by 6 0.9 UNDER(?:the )?open data commons *attribution LIC
odc-by 5 0.85 UNDER*odc by
pddl 6 0.9 UNDER(?:the )?public domain *dedication and LIC
pddl 5 0.85 UNDER(?:the )?*pddl
cdla 6 0.9 UNDER(?:the )?community data *LIC agreement
ogl 6 0.9 UNDER(?:the )?open *government LIC
openrail 5 0.85 UNDER(?:the )?(?:creativeml |bigscience )?(?:open ?rail) *LIC
free-art 6 0.9 UNDER(?:the )?free art *LIC
public-domain 4 0.7 (?:is |are |falls? |now )?in the public *domain
public-domain 5 0.8 (?:released|placed|dedicated) (?:in|into|to) the public *domain
public-domain 3 0.5 public *domain

# Terms that restrict
busl 6 0.9 UNDER(?:the )?business source *LIC(?:VER 1 1)?
sspl 6 0.9 UNDER(?:the )?*server side public LIC
sspl 5 0.85 UNDER(?:the )?*sspl
elastic 6 0.9 UNDER(?:the )?*elastic LIC(?:VER 2 0)?
commons-clause 6 0.9 UNDER(?:the )?commons *clause
polyform 6 0.9 UNDER(?:the )?*polyform (?:noncommercial|strict|shield|small business)
proprietary 5 0.8 UNDER(?:a |the )?*proprietary (?:software )?LIC
proprietary 4 0.7 all rights *reserved
proprietary 4 0.6 *confidential and proprietary
proprietary 5 0.7 (?:may|must|shall) not be (?:reproduced|copied|redistributed|distributed)(?: in any form)? without (?:the )?(?:prior |express )?(?:written )?*permission
proprietary 4 0.6 no part of this (?:publication|book|document|work) may be *reproduced
commercial 5 0.8 UNDER(?:a |the )?*commercial LIC
non-commercial 4 0.7 for (?:personal and )?non *commercial use only
non-commercial 4 0.7 for (?:personal and )?*noncommercial (?:use only|use|purposes)
evaluation 4 0.6 for *evaluation purposes only
eula 5 0.8 end user *LIC agreement
eula 4 0.7 UNDER(?:the |this )?*eula
shareware 4 0.7 *shareware
freeware 4 0.7 *freeware

# Notices
copyright 2 0.4 *copyright (?:c )?(?:19|20)[0-9]{2}
copyright 2 0.4 *copyright notice
copyright 2 0.4 *copyrighted (?:material|work|software)
warranty-disclaimer 3 0.6 provided as is without *warranty of any kind
warranty-disclaimer 3 0.6 provided as is without *warranties of any kind
warranty-disclaimer 2 0.5 (?:without|no) (?:any )?(?:express |implied )?*warranty
warranty-disclaimer 2 0.5 (?:without|no) (?:any )?(?:express |implied )?*warranties
warranty-disclaimer 3 0.6 *merchantability (?:and|or) fitness for a particular purpose
liability-disclaimer 3 0.5 in no event shall (?:[^ ]+ ){1,12}be *liable
patent-grant 3 0.5 royalty free *patent LIC
unknown-license 1 0.3 *licensed under
unknown-license 1 0.3 *LIC agreement
unknown-license 1 0.3 terms of (?:this|the|its) *LIC
unknown-license 1 0.3 see (?:the )?*LIC(?: file)? for details
unknown-license 1 0.3 *sublicense
"""


UNDER = "(?:(?:licen[sc]ed|released|distributed|available|published|provided) under )?(?:(?:the )?(?:terms|conditions) of )?"


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, confidence, expression), in order; the expression has MARK before its keyword."""
    out = []
    for line in RULES.splitlines():
        if not line or line.startswith("#"):
            continue
        label, priority, confidence, rx = line.split(" ", 3)
        rx = rx.replace("UNDER", UNDER).replace("LIC", "licen[sc]e").replace("VER ", "(?: version| ver| v)? v?")
        before, after = rx.split("*")
        if after.startswith("licen[sc]e"):
            rest = after.removeprefix("licen[sc]e")
            out += [(label, word, int(priority), float(confidence), f"{before}{MARK}{word}{rest}") for word in ("license", "licence")]
        else:
            word = "".join(c if c.isalnum() else " " for c in after).split(" ")[0]
            out.append((label, word, int(priority), float(confidence), f"{before}{MARK}{after}"))
    return out


#: Stands before the keyword in expressions and in the lines they are matched with; no word has it.
MARK = "\x01"
