"""Wording of public license texts and of the notices that refer to them."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """``marks`` are phrases that tell a text from its near relatives: a match has to hold each of them."""

    license: str
    text: str
    marks: tuple[str, ...] = ()


# fixed values: wording published by the authors of each license
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license",),
    ),
    Template(
        "Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
        "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    Template("MIT", "Released under the MIT License.", ("mit license",)),
    Template("MIT", "Licensed under the MIT License.", ("mit license",)),
    Template("MIT", "Distributed under the terms of the MIT License.", ("mit license",)),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    Template(
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    Template(
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("version 2", "gnu general")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("version 3", "gnu general")),
    Template(
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("version 2", "gnu general"),
    ),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("version 3", "gnu general"),
    ),
    Template(
        "GPL-2.0",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public "
        "License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        ("gnu general",),
    ),
    Template(
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        ("gnu general",),
    ),
    Template(
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("version 2 1", "lesser general"),
    ),
    Template(
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("version 3", "lesser general"),
    ),
    Template(
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("version 3", "affero general"),
    ),
    Template(
        "AGPL-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to "
        "ensure cooperation with the community in the case of network server software.",
        ("affero general",),
    ),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("v 2",)),
    Template(
        "MPL-1.1",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in '
        "compliance with the License.",
        ("version 1 1",),
    ),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("by nc",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("by 4",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("by sa",)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution 4",)),
    Template(
        "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("sharealike 4", "attribution sharealike")
    ),
    Template(
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        ("noncommercial 4", "attribution noncommercial"),
    ),
    Template(
        "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    Template(
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means.",
    ),
)

#: Of these, a document is given the last one that it holds: each text contains the ones before.
NESTED = ("BSD", "BSD-2-Clause", "BSD-3-Clause")
