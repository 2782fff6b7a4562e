"""Sentences of licence texts, as published, in the order of the text."""

# Sentences of the full texts, eight of each that no other of these texts has.
SENTENCES_OF = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "For the purposes of this License, Derivative Works shall not include works that remain separable from, or merely link (or bind by name) to the interfaces of, the Work and Derivative Works thereof",
        "The contents of the NOTICE file are for informational purposes only and do not modify the License",
        "You may add Your own attribution notices within Derivative Works that You distribute, alongside or as an addendum to the NOTICE text from the Work, provided that such additional attribution notices cannot be construed as modifying the License",
        "Notwithstanding the above, nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with Licensor regarding such Contributions",
        "You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License",
        'To apply the Apache License to your work, attach the following boilerplate notice, with the fields enclosed by brackets "[]" replaced with your own identifying information',
        'We also recommend that a file or class name and description of purpose be included on the same "printed page" as the copyright notice for easier identification within third-party archives',
    ],
    "Artistic-1.0-Perl": [
        "It also means that recipients of the item may redistribute it under the same conditions they received it",
        "You may make and give away verbatim copies of the source form of the Standard Version of this Package without restriction, provided that you duplicate all of the original copyright notices and associated disclaimers",
        "A Package modified in such a way shall still be considered the Standard Version",
        "You may distribute the programs of this Package in object code or executable form, provided that you do at least ONE of the following:",
        "You may charge any fee you choose for support of this Package",
        "However, you may distribute this Package in aggregate with other (possibly commercial) programs as part of a larger (possibly commercial) software distribution provided that you do not advertise this Package as a product of your own",
        "Aggregation of this Package with a commercial distribution is always permitted provided that the use of this Package is embedded",
        "The name of the Copyright Holder may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "CC0-1.0": [
        "CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES",
        "DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP",
        'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work")',
        'A Work made available under CC0 may be protected by copyright and related or neighboring rights ("Copyright and Related Rights")',
        "Should any part of the Waiver for any reason be judged legally invalid or ineffective under applicable law, then the Waiver shall be preserved to the maximum extent permitted taking into account Affirmer's express Statement of Purpose",
        "The License shall be deemed effective as of the date CC0 was applied by Affirmer to the Work",
        "Affirmer disclaims responsibility for clearing rights of other persons that may apply to the Work or any use thereof, including without limitation any person's Copyright and Related Rights in the Work",
        "Further, Affirmer disclaims responsibility for obtaining any necessary consents, permissions or other rights required for any use of the Work",
    ],
    "GFDL-1.3": [
        "Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc",
        'A "Modified Version" of the Document means any work containing the Document or a portion of it, either copied verbatim, or with modifications and/or translated into another language',
        'For works in formats which do not have any title page as such, "Title Page" means the text near the most prominent appearance of the work\'s title, preceding the beginning of the body of the text',
        "Copying with changes limited to the covers, as long as they preserve the title of the Document and satisfy these conditions, can be treated as verbatim copying in other respects",
        'Preserve the section Entitled "History", Preserve its Title, and add to it an item stating at least the title, year, new authors, and publisher of the Modified Version as given on the Title Page',
        "To do this, add their titles to the list of Invariant Sections in the Modified Version's license notice",
        "Translation is considered a kind of modification, so you may distribute translations of the Document under the terms of section 4",
        "If the Document does not specify a version number of this License, you may choose any version ever published (not as a draft) by the Free Software Foundation",
    ],
    "GPL-2.0": [
        "Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "These restrictions translate to certain responsibilities for you if you distribute copies of the software, or if you modify it",
        "If the software is modified by someone else and passed on, we want its recipients to know that what they have is not the original, so that any problems introduced by others will not reflect on the original authors' reputations",
        "The act of running the Program is not restricted, and the output from the Program is covered only if its contents constitute a work based on the Program (independent of having been made by running the Program)",
        "For an executable work, complete source code means all the source code for all modules it contains, plus any associated interface definition files, plus the scripts used to control compilation and installation of the executable",
        "Therefore, by modifying or distributing the Program (or any work based on the Program), you indicate your acceptance of this License to do so, and all its terms and conditions for copying, distributing or modifying the Program or works based on it",
        "If the Program does not specify a version number of this License, you may choose any version ever published by the Free Software Foundation",
        "BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW",
    ],
    "GPL-3.0": [
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
        "The systematic pattern of such abuse occurs in the area of products for individuals to use, which is precisely where it is most unacceptable",
        "If the interface presents a list of user commands or options, such as a menu, a prominent item in the list meets this criterion",
        "Conveying under any other circumstances is permitted solely under the conditions stated below",
        "A separable portion of the object code, whose source code is excluded from the Corresponding Source as a System Library, need not be included in conveying the object code work",
        "If the Program as you received it, or any part of it, contains a notice stating that it is governed by this License along with a term that is a further restriction, you may remove that term",
        'An "entity transaction" is a transaction transferring control of an organization, or substantially all assets of one, or subdividing an organization, or merging organizations',
        "Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU Affero General Public License into a single combined work, and to convey the resulting work",
    ],
    "LGPL-2.1": [
        "It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]",
        "If you link other code with the library, you must provide complete object files to the recipients, so that they can relink them with the library after making changes to the library and recompiling it",
        "The ordinary General Public License therefore permits such linking only if the entire combination fits its criteria of freedom",
        "For example, permission to use the GNU C Library in non-free programs enables many more people to use the whole GNU operating system, as well as its variant, the GNU/Linux operating system",
        "Therefore, Subsection 2d requires that any application-supplied function or table used by this function must be optional: if the application does not supply it, the square root function must still compute square roots.)",
        "Whether this is true is especially significant if the work can be linked without the Library, or if the work is itself a library",
        "You may not copy, modify, sublicense, link with, or distribute the Library except as expressly provided under this License",
        "THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE LIBRARY IS WITH YOU",
    ],
    "LGPL-3.0": [
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
        'As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License',
        "Defining a subclass of a class defined by the Library is deemed a mode of using an interface provided by the Library",
        'A "Combined Work" is a work produced by combining or linking an Application with the Library',
        'The "Minimal Corresponding Source" for a Combined Work means the Corresponding Source for the Combined Work, excluding any source code for portions of the Combined Work that, considered in isolation, are based on the Application, and not on the Linked Version',
        "You may convey a covered work under sections 3 and 4 of this License without being bound by section 3 of the GNU GPL",
        "If you use option 4d1, you must provide the Installation Information in the manner specified by section 6 of the GNU GPL for conveying Corresponding Source.)",
        "The Free Software Foundation may publish revised and/or new versions of the GNU Lesser General Public License from time to time",
    ],
    "MPL-1.1": [
        "When Covered Code is released as a series of files, a Modification is: A",
        "The Modifications which You create or to which You contribute are governed by the terms of this License, including without limitation Section 2.2",
        "Contributor represents that, except as disclosed pursuant to Section 3.4(a) above, Contributor believes that Contributor's Modifications are Contributor's original creation(s) and/or Contributor has sufficient rights to grant the rights conveyed by this License",
        "If You distribute the Executable version under a different license You must make it absolutely clear that any terms which differ from this License are offered by You alone, not by the Initial Developer or any Contributor",
        'Netscape Communications Corporation ("Netscape") may publish revised and/or new versions of the License from time to time',
        "SHOULD ANY COVERED CODE PROVE DEFECTIVE IN ANY RESPECT, YOU (NOT THE INITIAL DEVELOPER OR ANY OTHER CONTRIBUTOR) ASSUME THE COST OF ANY NECESSARY SERVICING, REPAIR OR CORRECTION",
        'The Covered Code is a "commercial item," as that term is defined in 48 C.F.R',
        'Initial Developer may designate portions of the Covered Code as "Multiple-Licensed"',
    ],
    "MPL-2.0": [
        'For legal entities, "You" includes any entity that controls, is controlled by, or is under common control with You',
        "The licenses granted in this Section 2 are the only rights granted under this License",
        "Each Contributor represents that the Contributor believes its Contributions are its original creation(s) or it has sufficient rights to grant the rights to its Contributions conveyed by this License",
        "You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License",
        "However, You may do so only on Your own behalf, and not on behalf of any Contributor",
        "The rights granted under this License will terminate automatically if You fail to comply with any of its terms",
        "Nothing in this Section shall prevent a party's ability to bring cross-claims or counter-claims",
        "You may distribute the Covered Software under the terms of the version of the License under which You originally received the Covered Software, or under the terms of any subsequent version published by the license steward",
    ],
    "AGPL-3.0": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software",
    ],
}
# Titles of the public licences that share one text but for the title.
CREATIVE_COMMONS = {
    "CC-BY-4.0": "Attribution",
    "CC-BY-SA-4.0": "Attribution-ShareAlike",
    "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}
ACCEPTANCE = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License (\"Public License\")"
