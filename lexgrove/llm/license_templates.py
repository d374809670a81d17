"""Licence wording as templates: fixed values.

``<<beginOptional>>`` and ``<<endOptional>>`` enclose words that may be left out;
``<<var;words=a-b>>`` stands for a to b words of any kind; all other words are mandatory.
Case, punctuation and line breaks do not count.
"""

#: Fixed phrases and their labels.
PHRASES = {"mit": ["mit license"], "apache": ["apache license"], "gpl": ["general public license"]}

#: Published licence texts and notices by their public identifiers.
TEMPLATES = {
    "Apache-2.0": [
        "licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0",
        "Apache License <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>January 2004<<endOptional>>",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>"
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
        "BSD 2 Clause <<beginOptional>>Simplified<<endOptional>> License",
    ],
    "BSD-3-Clause": [
        "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;words=1-20>> nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written permission.",
        "BSD 3 Clause <<beginOptional>>New or Revised<<endOptional>> License",
    ],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"],
    "CC-BY-NC-4.0": [
        "CC BY NC 4.0",
        "Creative Commons Attribution NonCommercial 4.0 International <<beginOptional>>Public<<endOptional>> License",
        "Creative Commons Attribution Non Commercial 4.0 International <<beginOptional>>Public<<endOptional>> License",
    ],
    "CC-BY-SA-4.0": ["CC BY SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International <<beginOptional>>Public<<endOptional>> License"],
    "CC0-1.0": ["CC0 1.0 <<beginOptional>>Universal<<endOptional>>"],
    "GPL-2.0": [
        "GNU General Public License<<beginOptional>>,<<endOptional>> <<beginOptional>>as published by the Free Software"
        " Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    ],
    "GPL-3.0": [
        "GNU General Public License<<beginOptional>>,<<endOptional>> <<beginOptional>>as published by the Free Software"
        " Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    ],
    "ISC": [
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License"],
    "MIT": [
        "under <<beginOptional>>the terms of<<endOptional>> the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1-8>> and associated"
        " documentation files <<beginOptional>>the Software<<endOptional>> to deal in the Software without restriction, including"
        " without limitation <<beginOptional>>on<<endOptional>> the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject"
        " to the following conditions: The above copyright notice and this permission notice <<beginOptional>>including the next"
        " paragraph<<endOptional>> shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License<<beginOptional>>,<<endOptional>> v. 2.0", "Mozilla Public License <<beginOptional>>Version<<endOptional>> 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
