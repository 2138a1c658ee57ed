"""Training of the span model of ``pii`` on generated, labelled lines.

    python -m quillstate.llm.pii_train            # writes pii_weights.json

Lines are made from forms with slots; a slot is filled by a generator of its kind, and its
place is the label. Streets, numbers and most names are invented here; given names that are
also words (Rose, Mark) are ordinary ones. In every line a random part of the name words
counts as listed, so that the model learns to do without the list. Every fifth form, chosen by
a hash of its text, is never trained on; accuracy is measured on those. The likelihood of the
labelled segmentation is maximised by AdaGrad over the exact lattice of ``pii.candidates``
(forward and backward sums over the same states the decoder uses), with L2 shrinkage, while
features that name context words are hidden at random.
"""

from __future__ import annotations

import json
import math
import random
import sys
import zlib
from collections import defaultdict

from quillstate.llm.pii import KINDS, WEIGHTS, Gazetteer, Model, candidates, decoder, spans_of

SYLL = ["bar", "mel", "tor", "vin", "kes", "lan", "dor", "ash", "rid", "wen", "gor", "hal", "nis", "quil", "stra", "mond", "fen", "cas", "ther", "ow", "el", "mar", "jan", "sol", "bri", "ked", "zal", "pri", "und", "yar", "tess", "øl", "mül", "ñez", "szy", "ève"]
NOUNS = ["cache", "table", "socket", "quota", "layout", "router", "shard", "token", "ledger", "widget", "profile", "report", "handler", "window", "lease", "billing", "parser", "gradient", "import", "export"]
TWO_WORDS = ["Golden Harbor", "Night Market", "Silver Fox", "Open Sky", "Stone Bridge", "Quiet River", "Safe Mode", "Load Test", "Trial Period", "Main Branch", "Red Maple", "High Street", "Bloom Filter", "Park Assist", "Paper Crane", "Winter Palace", "Rose Window", "Frank Talk", "Mark Down", "Grace Note", "Dawn Patrol", "Victor Loop", "Iris Lens", "Rose Quartz", "Mark Two", "Frank Theorem", "Miles Ahead", "Dawn Chorus", "Quiet Lamp", "Copper Kettle", "Long Walk", "Tidy Room", "Main Road", "Iron Gate", "Will Call", "Green Valley", "Grace Window", "Mark Phase"]
TOWNS = ["Brookhaven", "Lindmere", "Castro Nova", "Sankt Velden", "Port Marlin", "Eastwick", "Pont-Clair", "Havnsund", "Villar Baja", "Stonegate"]
HOSTS = ["mill.test", "blue-hill.example", "xn--kva-tna.example", "mx.pond.example", "labs-kite.example.org", "stone.invalid", "post.weiler.example", "eastbay.example.com", "n.lamp.test", "city.example.net"]
LOGINS = ["bram", "tess", "kilo", "wanda", "orrin", "pax", "merge-bot", "ci-runner", "docs-sync", "ursa"]
CYR = ["Олег", "Мария", "Пётр", "Ирина", "Захар", "Вера"], ["Лесницкий", "Громова", "Ветров", "Береговая", "Сомов", "Ржевская"]
B85 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
KANJI = "山川田中村上木本高橋佐藤鈴森林池清水原野葉月白雪朝槙鳥"
KANA = "あいうえおかきくけこさしすせたちつてとなにのはひふみむもやゆよらりるれわ"

#: Forms with labelled slots {N} name {C} Cyrillic name {J} Japanese name {E} {P} {I} {A}; other slots are filler.
#: {G} is one given name, labelled as a name. Forms of tools (trailers, mail headers, exports) are written as the tools write them.
POSITIVE = [
    # headers, trailers and signatures
    "Author: {N} <{E}>", "From: {N} <{E}>", "# User {N} <{E}>", "{trailer}: {N} <{E}>", "{trailer}: {N}", "{trailer}: {N}", "{trailer}: {E}", "To: {N} <{E}>, {N} <{E}>", "Committer: {N} <{E}>", "committed by {N} <{E}>", "commit by {N} <{E}>", "by {N} <{E}> at {date}", "written by {N} on {date}",
    "+++ b/{W} {N} <{E}>", "* {N} <{E}>", "@author {N}", "@author {N} <{E}>", "# Author: {N}", "// Author: {N} <{E}>", "__maintainer__ = '{N}'", 'author = "{N}"', "Copyright (c) {year} {N}", "(C) {year} {N} <{E}>", "Written {year} by {N}", "{N} wrote:", "On {date}, {N} wrote:", "Regards, {N}", "Best, {N}", "Cheers, {G}", "Thanks, {G}", "Kind regards\t{N}", "-- {N}", "sent by {N}", "{N}, {date}",
    "{N} {verb} the {w}.", "{N} {verb} {two}", "// {N} {verb} this, {P}", "// {N} {verb} it, mail {E}", "# {N} {verb} the {w} here", "{N} and {N} {verb} it together.", "{pre}{N}'s {w} is gone", "At {N}'s wish, drop the {w}.", "{pre}see {N}'s note on the {w}", "a complaint by {N}", "the {w} of {N} failed; {N} {verb} it", "{place}: {N} {verb} the {w}", "{P}: {N}", "{pre}{P} is {N}", "{pre}on the phone with {N}, {P}", "{pre}{E} is on duty", "{E} was told to wait, see {w}", "{P} was called by the {w}", "{P} called twice", "{A} was moved", "{A} has no {w}", "access by {E} only, room at {A}", "either {E} or {P}", "backup: {E}, or {P}", "{N} ({P}) or {N} ({E})", "{C} ({E})", "{J} <{E}>", "{J} が {w} を見た。", "連絡は {E} へ", "{P} に電話する。", "住所は {A} です。", "Доставка: {A}", "письмо от {C}", "Звонил {C}, {P}.",
    "the number ({I}) is shown in full", "never print ({I}) here", "{I} is valid but was refused", "a national number like {I} fails", "VAT-ID {I} removed", "Tax-ID {I}", "tax ID {I} in clear", "USt-ID {I} entfernt", "ID {I} found", "IDs {I} and {I}", "log line with {I} in it", "({I})", "'{I}'", "{I},", "{N}: {I}", "{num},{N},{P},{I}", "{num};{P};{I}", "('{I}', '{P}')", "('{N}', '{I}', '{P}'),", "INSERT INTO {w}s VALUES ({num}, '{N}', '{A}', '{I}');", "INSERT INTO persons VALUES ({num}, '{I}');", "{{id: '{I}', owner: '{N}'}}", "{{ pid: '{I}', mail: '{E}' }},", "--- {N} / {E}", "+-- {P} / {N}", "({I}) once more", "({I}) is gone now", "{I} des clients", "{I} aus der Datei", "{I}\t{N}", "| {I} | {N} |", "Number {I} of {N}", "Nummer {I} von {N}", "numéro {I} de {N}", "número {I} de {N}", "номер {I}", "{num},{N},{A},{E}", "{num}\t{P}\t{N}", "{N}\t{A}\t{town}", "{N};{num};{P}",
    # people in sentences
    "{pre}spotted by {N} during {w} tests.", "{pre}credit goes to {N}, as does the {w} idea.", "As {N} pointed out, the {w} leaks.", "{N} suggested a simpler {w}.", "{N} says that the {w} is fine.", "I spoke to {N} about the {w}.", "Please send it to {N} by Friday", "Please forward the {w} to {N} before noon.", "Meeting with {N} and {N} about the {w}", "Assigned to {N}", "Assign {N} to the {w} review.",
    "{pre}approved by {N}", "{pre}requested by {N} last week", "According to {N}, the {w} must stay.", "The patch from {N} broke the {w}.", "{title} {N} will look at it.", "We met {title} {N} in {town}.", "{N} no longer works here.", "the {w} belongs to {N}", "{pre}{N} is on holiday until {date}.", "My name is {N} and the {w} is mine.", "This is {N} from {town}.", "Contact {N} first.", "Call {N} at {P}.", "Call {N} at {P} or write to {E}", "Email {N} at {E}", "Ask {N} or {N}.", "Ping {N}", "Please give it to {N} by {wd}", "Hand the {w} to {N} by noon.", "Please show {N} the {w}.", "sent it to {N} on {wd}", "it went to {N} by mail", "give {N} a call by {date}", "a {w} of {N}", "photo of {N}", "{W} card of {N}", "call {N}", "call {N} today", "Date: met {N}", "{W}: ask {N}", "for {N} und {N}", "Gruß an {N} für die {w}s", "Test account is {N}, card {I}", "the user is {N}, {w} {I}, {P}", "// HACK({N}): {w}", "// BUG({N}) see {ver}", "Talk to {N} before the {w} goes out.",
    "# FIXME({N}): {w} is wrong", "/* HACK({N}) until {ver} */", "# {N}: why is this {w} here?", "# reviewed with {N}", "-- {N} wants this {w} gone", "// see {N} about the {w}", "// by {N}, reach me under {P}", "# {N} has the {w} password, {E}", "Co-written with {N} ({E})", "Idea: {N}. Code: {N}.", "Patch by {N}, tests by {N}.", "Hat tip {N}!", "Kudos to {N} and {N}.", "Hi {G},", "Hello {N},", "Dear {title} {N},",
    "Mein Name ist {N}.", "Mit {N} besprochen.", "Vielen Dank an {title} {N}!", "Wunsch von {N} ({E}).", "Laut {N} ist der {w} kaputt.", "Fehler gefunden von {N}.", "Ansprechpartner: {N}, Telefon {P}", "Je m'appelle {N}.", "Trouvé par {N}.", "Vu avec {N} ({E}).", "Selon {N}, le {w} fuit.", "Remerciements à {N}.", "Me llamo {N}.", "Encontrado por {N}.", "Hablado con {N} ({E}).", "Según {N}, el {w} falla.", "O meu nome é {N}.", "Encontrado por {N} em {date}.", "Falei com {N} ({E}).", "Segundo {N}, o {w} falha.", "Нашёл {C}.", "Спасибо, {C}!", "Автор: {C} <{E}>", "Согласовано с {C} ({E}).", "担当: {J}", "作成者 {J} <{E}>", "{J} さんに感謝します。", "{J} ({P})", "レビュー: {J}", "{N} さんより",
    # addresses of mail and numbers to call
    "write to {E}", "{pre}mail to {E} bounced", "bounced: {E}", "E-mail: {E}", "email={E}", "<{E}>", "mailto:{E}", "user {E} cannot log in", "CREATE USER for {E}", "GRANT SELECT TO '{E}';", "{pre}send the {w} to {E} please", "subscribe {E} to the {w}", "recipients: [{E}, {E}]", "'{E}',", '"{E}": true,', "alert_to: {E}", 'from = "{E}"', "admin = {E}", "{login} is now {E}", "@{login} or {E}", "Kontakt: {E}", "Bitte an {E} schreiben.", "Courriel : {E}", "Merci d'écrire à {E}.", "Correo: {E}", "Para acceso, {E}.", "Correio: {E}", "Почта: {E}", "Пишите на {E} по поводу {w}.", "メール: {E}", "{E} へどうぞ。",
    "Phone: {P}", "tel: {P}", "fax {P}", "mobile = '{P}'", "call me on {P} tonight", "{pre}ring {P} if it fails", "dial {P} for help", "Our hotline is {P}.", "{pre}the sample number {P} is real", "sms({P})", 'phone: "{P}",', "phone={P}", "tel://{P}", "Call {P} before the release.", "Call {P}", "Text {P} when the {w} is down", "number {P} rings nobody", "Telefon: {P}", "Bitte {P} wählen.", "Rufnummer {P}", "Tél. : {P}", "Téléphoner au {P}.", "Teléfono: {P}", "Llame al {P}.", "Telefone: {P}", "Ligue para {P}.", "Телефон: {P}", "Позвонить {P}.", "電話: {P}", "電話番号 {P} です。", "office {P}, mobile {P}",
    # identity numbers
    "My SSN is {I}", "SSN: {I}", "{pre}social security number {I} leaked", "national id {I}", "Passport: {I}", "passport no {I} of {N}", "tax id {I}", "TIN {I}", 'taxId = "{I}"', "person_id: '{I}'", "check_ssn('{I}')", "assert is_valid('{I}')", "id card {I} was in the log", "NINO {I}", "insurance number {I}", "{pre}number {I} must not be printed", "{N} (id {I})", "Personalausweis: {I}", "Reisepass {I} gelöscht.", "Steuernummer {I}", "Numéro fiscal {I}", "Passeport {I} retiré.", "NIR {I}", "DNI {I}", "Pasaporte {I} borrado.", "Documento n.º {I}", "Passaporte {I} apagado.", "Паспорт {I}", "ИНН {I}", "旅券 {I}", "番号 {I} を消した。",
    # street addresses
    "Address: {A}", "address = '{A}'", "lives at {A}", "{N}, {A}", "{N}, {A}, {place}", "Ship to {A}, {place}", "Deliver to {A} only", "{pre}moved to {A}", "our office: {A}, {place}", "shipping_address: {A}", 'home="{A}"', "The map puts {A} in the sea.", "{pre}label for {A} was cut off", "the parcel for {A} came back", "pick up at {A}, {place}", "at {A} since {year}", "{title} {N}, {A}", "Anschrift: {A}, {place}", "Wohnhaft {A}.", "Adresse : {A}, {place}", "Habite au {A}.", "Domicilio: {A}, {place}", "Vive en {A}.", "Endereço: {A}, {place}", "Mora em {A}.", "Адрес: {A}", "住所 {A}",
    # records
    "{num},{N},{E},{P}", "{N},{I},{date}", "{num};{N};{A};{P}", "{N};{E};{P};open", "id,{I},{N},{num}", "{N}\t{E}\t{P}", "{num}\t{N}\t{A}\t{place}", "{P},{N},{num}", "{E},{N}", "{I},{P},{E}", "| {num} | {N} | {P} | {I} |", "|{N}|{A}|{place}|", "{N} / {E} / {P}", "{N} | {P}", "{N} - {P}", "{N}, {P}", "{N}, {E}", "{E}; {P}", "{A}; {P}",
    '{{"person": "{N}", "phone": "{P}"}}', '"name": "{N}",', '"tel": "{P}", "mail": "{E}"', '{{"ssn": "{I}"}}', '"personal_id": "{I}",', '"address": "{A}", "town": "{town}"', "name: {N}", "customer: {{name: {N}, phone: {P}}}", "client: '{N}', id: '{I}'", "User(name='{N}', email='{E}')", 'Person("{N}", "{A}", "{P}")', "new Client('{N}', '{I}')", "('{N}', '{E}', {num})", '["{N}", "{I}"],', '[{num}, "{N}", "{A}"],', "{{ name: '{N}', tel: '{P}' }},", "{{Name: \"{N}\", Street: \"{A}\"}},", "owner={N};phone={P}", "<name>{N}</name>", "<td>{N}</td><td>{P}</td>", "<street>{A}</street>", "<tel>{P}</tel>", "<ssn>{I}</ssn>",
    "INSERT INTO clients (name, tel) VALUES ('{N}', '{P}');", "INSERT INTO {w}s VALUES ('{I}', '{N}', {num});", "INSERT INTO addresses VALUES ({num}, '{A}', '{town}');", "UPDATE clients SET tel = '{P}' WHERE name = '{N}';", "UPDATE {w} SET mail = '{E}' WHERE id = {num};", "DELETE FROM {w}s WHERE ssn = '{I}';", "DELETE FROM clients WHERE phone = '{P}' OR mail = '{E}';", "SELECT * FROM {w}s WHERE email = '{E}' AND tel = '{P}';", "SELECT id FROM clients WHERE name = '{N}';", "SELECT {w} FROM users WHERE ssn = '{I}'", "ALTER USER '{E}' SET {w} = {num};",
]
#: Forms without personal information.
NEGATIVE = [
    # commit headers, trailers of accounts, messages of machines
    "Author: {log}", "From: {log}", "# User {log}", "by {log} on {date}", "{trailer}: {log}", "{trailer}: {bot}", "{trailer}: {bot}", "Author: {bot}", "Committer: {bot}", "Owner: {log}", "cc @{login} @{login}", "commit {sha40}", "commit {d8}{sha}", "Date:   {wd} {mon} {d2} {time} {year} +{d4}", "Date: {wd}, {d2} {mon} {year} {time} -{d4}", "# Date {d10} -{d4}", "# Node ID {sha40}", "# Parent  {sha40}", "# HG changeset patch", "From {sha40} {wd} {mon} {d2} {time} {year}", "Merge: {h7} {h7}", "Merge commit '{d8}' into {w}", "Merge commit '{sha}' into {w}", "Subject: [PATCH] Merge commit '{d8}' into {w}", "Merge pull request #{num} from {login}/{w}-{w}", "Merge branch '{w}-{w}' of {w}", "Merge tag 'v{ver}' into {w}", "This reverts commit {sha}.", "(cherry picked from commit {sha})", "Fixes: {sha} ({w} {w})", "Reverts {d8} and {sha}.", "Subject: [PATCH {d1}/{d2}] {W} the {w}", "Change-Id: I{sha40}", "Message-Id: <{ts}.{hex}@{w}.mailer>", "git-svn-id: https://svn.example/{w}/trunk@{num} {uuid}", "Conflicts: src/{w}_{w}.py",
    # diffs
    "diff --git a/{w}/{w}_{w}.py b/{w}/{w}_{w}.py", "index {h7}..{h7} 100644", "index {d7}..{h7} 100644", "index {h7}..{d7} 100644", "index {d7}..{d8}..{h7}", "index {d8}..{d7}", "index {h7}..{h7}", "--- a/{w}/{w}.{w}", "+++ b/{w}/{w}_{w}.go", "@@ -{d3},{d1} +{d3},{d1} @@", "@@ -{d2},{d1} +{d2},{d2} @@ func (t *{W}) {W}() error {{", "@@ -{d3},{d1} +{d3},{d1} @@ def {w}(self, {w}):", "literal {d3}", "GIT binary patch", "z{b85}", "c{b85}", "{b85}", "Y{b85}{b85}", "\\ No newline at end of file", "similarity index {d2}%", "rename from {w}/{w}.{w}", "new file mode 100644", "-- ", "2.{d2}.{d1}",
    "/* {two} theme */", "// {two} layout", "width: {d4}px; /* {two} */", "height: {d3}px; // {two}", "# {two} build", "{two} train: {ver}", "Train {two} {ver}", "Codename {two}, {ver}", "project {two}", "theme: {two}", "milestone = '{two}'", "label: \"{two}\"", "{W}: {two}", "see the {two} page", "the {two} flag", "on {two} day", "all of {two}", "without {two}", "{two}, {two} and {two}", "({two})", "\"{two}\"", "'{two}',", "{num},{two},{ver}", "| {two} | {ver} |", "{two} by default", "{two} wants a {w}", "{two} needs the {w}", "reset {two}", "Plan {two}: {w}, {w}", "{two} の {w}", "Planung: {two}", "Plan : {two}", "entrega {two}", "Выпуск {two} {ver}", "{w} の変更はない。", "{w} を変えない。", "動作は同じ。", "挙動に変わりはありません。", "不要な {w} の整理。", "{w} の読み込みを速くする", "再起動のあとも {w} が残る。", "設定を確認する。", "試験の追加", "翻訳の更新",
    '"{w}@{ver}": "{ver}",', '"{w}-{w}@{ver}"', "'{w}@{ver}',", "+ {w}@{ver}", "{w}-{w}@{ver}", "{w}_{w}@{ver} installed", "removed {w}@{ver}", "{w}@{ver}:", "pkg:{w}@{ver}", "{w}/{w}@{ver}", "logo@{d1}x.png", "{w}@{d1}x.svg", "icons/{w}-{w}@3x.png", "git@{w}.example:{w}.git", "origin git@code.example:{w}/{w}-{w}.git", "{w}:{rnd}@{w}.example",
    "serial: SN-{d9}", "S/N {d9}", "SN{d8}", "sn = 'SN-{d8}'", "serial_{w} = \"{d9}\"", "asset {W}-{d9}", "{W}-{d8} sold", "part {d9}",
    "Keine neuen {W}s.", "Kein {W} mehr nötig.", "Neue Tests für {w}", "Alte Tests entfernt", "Kleine Korrektur am {w}", "Bessere Meldung bei leerem {w}", "Leere Zeilen entfernt", "Großer Umbau im {w}", "Ohne Wirkung auf {w}.", "Erste Fassung", "Zweite Runde {w}", "Aucune incidence sur {w}.", "Petite Correction du {w}", "Nouveaux Tests", "Pas de {w} ici.", "Ningún efecto en {w}.", "Pequeño arreglo de {w}", "Nuevas Pruebas", "Nenhum efeito em {w}.", "Novos Testes", "Без изменений в {w}.", "Новые тесты", "Мелкая правка {w}", "No Functional Effect", "First Draft", "Second Try at {w}", "Small Fixes", "Better {W} Names", "Old Code Removed", "once {two} is out", "when {two} lands, drop {w}", "until {two} arrives", "after {two} goes live", "while {two} waits",
    "Passt zu {two}; {w} folgt.", "Zählt zu {two}; ohne {w}.", "Teil von {two}; {w} ist aus.", "{W} für {two}; {w} wartet noch.", "Dient {two}; kein {w}.", "Fait partie de {two} ; {w} attend.", "Sirve para {two}; falta el {w}.", "Serve {two}; falta o {w}.", "Нужно для {two}; {w} позже.", "serves {two}; no {w} yet", "kept for {two}; {w} off", "{b85}{b85}", "z{b85}", "Rund um {two}: {w}", "Nach {two} kommt {w}.", "Mit {two} kommt der {w}.", "Avec {two}, le {w} change.", "Autour de {two}: {w}", "Con {two} cambia el {w}.", "Com {two} muda o {w}.", "du {w} et des {w}s", "le {w} des tests", "aus den {w}s", "der {w} von den {w}s", "not the {w} any more", "({w}) any more", "{d10} des {w}s", "{d5}{d10} de {w}", "{d3} des lignes", "{d3} aus der {w}", "({w}) no longer", "the {w} again and again", "too many {w}s here",
    "number of {w}s: {d8}", "number {d5} of {d6}", "no. {d7}", "the number {d4}-{d3}", "ID {d8}", "id {d4}-{d4}", "{w} id {hex}", "номер {d6}", "Nummer {tick}", "numéro {tick}",
    # prose about things
    "The {two} release needs a new {w}.", "{W} now waits for {two}.", "{two} is late; keep the {w} off.", "{two} will use the {w} as well.", "Moves {two} to the new {w}.", "Found in {two}, not in {w}.", "{two} {ver} is out", "Prepare {two}", "Port of {two} to {W}", "Wartet auf {two}; {w} bleibt aus.", "En attente de {two}, {w} désactivé.", "Falta {two} para el {w}.", "Depende de {two} para o {w}.", "Ждём {two}, {w} выключен.", "{two} を待つ。", "For {two} see page {d2}.", "Take the {w} off the {two} list", "{two}: {w} and {w}",
    "Bug {num}, build {bld}.", "Ticket {tick} has the {w}.", "Refs #{num}, {num} and CORE-{d3}.", "Siehe {tick} und Fall {num}.", "Voir {tick}, version {bld}.", "Véase {tick} y {num}.", "Ver {tick} e build {bld}.", "Смотри {tick}, сборка {bld}.", "チケット {tick} を参照。", "took {num} ms, was {num} ms", "{d3} of {d4} {w}s moved", "runs on {ver} with {num} {w}s", "Tested on 192.0.2.{d3} and {ver}.", "host 198.51.100.{d2} port {d4}", "Sync at {ts}", "nightly {ts} done", "{d4} strings updated", "Release {ver}", "Bump {w} from {ver} to {ver}", "{w}: {w} the {w} {w}", "Fix {w} when {w} is empty", "{W} {W} {W}", "The {W} of the {W} is gone.", "Add {W} support to {w}", "Remove dead {w} code", "No change in {w}.", "{W} no longer blocks {W}", "Der {w} war leer, wenn {w} fehlt.", "{W} aus dem {w} entfernt", "Corrige le {w} du {w}", "Arregla el {w} vacío", "Corrige o {w} vazio", "Исправлен {w} для {w}", "Удалён {w}", "{w} が空のとき {w} を直す", "{w} の古い {w} を消す", "This is the last {w} before {w}.", "Office hours moved to {town}", "The {W} team meets in {town}.", "Reviewers: {W} team", "Tested by the {w} runner", "Approved by {w} policy", "thanks to the new {w}", "by default {w} is on", "ask the {w} for more", "Keep {W} and {W} apart", "call {w} and {w} first", "Call {W} twice", "Name of the {w}", "the author of {w} is unset", "Thanks, all", "Hello {w}", "Best {w} wins",
    # code and settings
    "if {w} is None:", "import {w}.{w}", "from {w} import {w}, {w}", "    return self.{w}[{d4}]", "for {w} in {w}s:", "raise ValueError(\"{w} {w}\")", "func (t *{W}) {W}() error {{", "std::vector<{W}> {w}s;", "#include <{w}/{w}.h>", "export function {w}{W}() {{", "const {w} = await {w}.get({d4});", "static const uint32_t k{W}[] = {{0x{hex}, 0x{hex}}};", "// {w} {w} {w}", "# {w} the {w} {w}", "/* {W} {w} */", "## {W} and {w}", "- {W} {w}", "  enabled: true", "  - name: {w}-{w}", "  {w}: {d4}", '"{w}": {d4},', '"{w}": "{w} {w}",', "{w} {w}", "{w} {w} {w}", "{w}={d4};var {w}=[{d4},{d3}];", "{d4},{w},{w},{d3}", "{d4};{w};{w};{d2}", "{num},{w},{w},{w},{ver}", "{w}\t{d4}\t{ver}", "| {w} | {w} | {d3} |", "background: url(/img/{w}@{d1}x.png);", "src=\"{w}-{w}@2x.jpg\"", '"{w}-{w}@{ver}": "^{ver}",', "{w}@{ver}", "npm i {w}@{ver}", "remote = git@code.example:{w}/{w}.git", "url = ssh://git@{w}.example/{w}.git", "DATABASE_URL=postgres://svc_{w}:{hex}@db.{w}.example:5432/{w}", "dsn = amqp://{w}:{rnd}@mq.{w}.invalid/vh", "https://{login}:{rnd}@{w}.example/{w}", 'API_TOKEN = "tok_{rnd}{rnd}"', "password: {rnd}", "secret_{w} = {hex}{hex}", "-----BEGIN {W} PRIVATE KEY-----", "@media (min-width: {d4}px) {{", "@Override", "@{w}.setter", "uuid: {uuid}", "id = {uuid}",
    'serial = "SN-{d10}"', "serial: {d2}-{d4}-{d5}", 'order_no = "{ord}"', "order {ord} shipped", "invoice {ord}", "part no. {tick}-{d4}", "account {d10}{d4}", "iban_{w} = {d3}", "checksum {d5} {d4} {d7}", "checksum {d4} {d3} {d6}", "crc {d10}", "size {d7} bytes", "ts={ts}", "timestamp: {d10}{d3}", "{d10}{d3} {w} started", "seed = {d8}", "[{d3}, {d3}, {d3}, {d4}]", "{d3} {d3} {d4} {d2}", "{d2}/{d2}/{year} {time}", "{date} {time} {w} {w}", "build {b3}", "# build {b3}", "version {b3}", "{d4}x{d4} pixels", "port {d5}", "ping 192.0.2.{d3} port {d3}", "10.{d2}.{d2}.{d3}", "level {d1} drive C: {d4} MB", "route {d3} -> lane {d1}", "{d2}-way {w} set, {d3} lanes", "{d2} {W} and {d2} {W} left", "Street Fighter mode {d1} for {W}", "Run {d2} Main Loop iterations", "Lane {d2} stays open", "Drive {d1} of {d2}", "{d2} way {w}", "step {d1} of {d1} close {w}", "{d3} square {w}s", "see court {w} {d2}", "place {d2} {w}s in a row",
    "SELECT {w}, {w} FROM {w} WHERE {w}_id = {d4};", "SELECT count(*) FROM {w}s WHERE {w} > '{date}';", "ALTER TABLE {w} ADD COLUMN {w} VARCHAR({d2});", "ALTER TABLE {w}s DROP COLUMN {w};", "CREATE INDEX idx_{w}_{w} ON {w} ({w});", "CREATE TABLE {w} (id BIGINT, {w} TEXT);", "INSERT INTO {w} VALUES ({d4}, '{w}', {d2});", "INSERT INTO {w}s ({w}) VALUES ('{w} {w}');", "UPDATE {w} SET {w} = {d4} WHERE id = {num};", "DELETE FROM {w} WHERE {w} < {d8};",
]
#: Every fifth form is never trained on; ``held_out`` measures on those.
KEPT_OUT = 5


def split_forms() -> tuple[tuple[list[str], list[str]], tuple[list[str], list[str]]]:
    """(positive, negative) forms to train on, and those held out."""
    def part(forms: list[str], held: bool) -> list[str]:
        return [f for f in dict.fromkeys(forms) if (zlib.crc32(f.encode()) % KEPT_OUT == 0) == held]

    return (part(POSITIVE, False), part(NEGATIVE, False)), (part(POSITIVE, True), part(NEGATIVE, True))


class Maker:
    """Lines from forms; ``held`` takes the forms that are never trained on."""

    def __init__(self, seed: int, held: bool = False):
        self.r = random.Random(seed)
        self.positive, self.negative = split_forms()[held]

    def part(self) -> str:
        r = self.r
        return "".join(r.choice(SYLL) for _ in range(r.choice((2, 2, 2, 3)))).capitalize()

    def name(self) -> tuple[str, list[str], list[str]]:
        r = self.r
        g, f = self.part(), self.part()
        given, family = [g], [f]
        if r.random() < 0.25:  # words that are also ordinary
            g = r.choice(["Rose", "Grace", "Mark", "Frank", "Will", "Dawn", "Iris", "Victor", "Miles", "Paige", "Hana"])
            given = [g]
        x = r.random()
        first = g
        if x < 0.12:
            first = g[0] + "."
        elif x < 0.24:
            first = f"{g} {r.choice('ABCDEFHIJKLMNOPRSTW')}."
        elif x < 0.31:
            h = self.part()
            given.append(h)
            first = f"{g}-{h}"
        last = f
        y = r.random()
        if y < 0.1:
            h = self.part()
            family.append(h)
            last = f"{f}-{h}"
        elif y < 0.17:
            last = f"{r.choice(('von', 'van der', 'de la', 'dos', 'van', 'da', 'de'))} {f}"
        elif y < 0.22:
            last = "O'" + f
        s = f"{first} {last}"
        z = r.random()
        if z < 0.05:
            s = s.upper()
        elif z < 0.09 and "." not in s:
            s = s.lower()
        elif z < 0.14 and x > 0.31:
            s = f"{last}, {first}"
        return s, given, family

    def email(self) -> str:
        r = self.r
        a, b = self.part().lower(), self.part().lower()
        local = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", b, f"{a}{r.randint(1, 99)}", f"{a}+{r.choice(NOUNS)}", f"{a.capitalize()}.{b.capitalize()}", "ops", "support", "noreply", "hello"])
        local = "".join(c for c in local if c.isascii()) or "x"
        host = r.choice(HOSTS)
        x = r.random()
        if x < 0.78:
            s = f"{local}@{host}"
            return s.upper() if r.random() < 0.04 else s
        if x < 0.84:
            return f"{local}(at){host}"
        if x < 0.89:
            return f"{local} [at] {host}"
        if x < 0.93:
            return f"{local}＠{host}"
        return f"{local} at {host.replace('.', ' dot ')}"

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "d" else c for c in form)

    def phone(self) -> str:
        forms = ["+44 (0)1632 960 ddd", "+44 1632 960ddd", "01632 960ddd", "07700 900ddd", "020 7946 0ddd", "+33 1 99 00 dd dd", "01 99 00 dd dd", "06.39.98.dd.dd", "+49 30 23125 ddd", "0049 30 23125-ddd", "030/23125ddd", "+1-ddd-555-01dd", "ddd-555-01dd", "(ddd) 555-01dd", "+1ddd55501dd", "1 ddd 555 01dd", "ddd.555.01dd", "+61 491 570 ddd", "(02) 5550 dddd", "０９０-００００-dddd", "+dd ddd ddd dddd", "0ddd ddddddd", "0dd ddd dd dd", "ddd-dddd", "+1 (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "0dddd dddddd", "0ddd ddd dddd", "0d dd dd dd dd", "+dd d dd dd dd dd", "+dd-ddd-ddd-dddd", "0d-dddd-dddd", "8 (ddd) ddd-dd-dd", "+7 ddd ddd-dd-dd"]
        s = self.digits(self.r.choice(forms))
        return s.translate(str.maketrans("0123456789", "０１２３４５６７８９")) if "０" in s else s

    def identity(self) -> str:
        forms = ["ddd-dd-dddd", "9dd-dd-dddd", "9dd dd dddd", "9dddddddd", "19dddddd-98dd", "dddddd-98dd", "00dddddd-L", "QQ dd dd dd M", "QQddddddM", "00dd dddddd", "Xdd ddddd", "Xddddddd", "0dddddddddd", "0d ddd ddd ddd", "2 dd 99 75 ddd ddd dd", "2dd9975dddddddd"]
        s = self.digits(self.r.choice(forms))
        return s.replace("L", self.r.choice("AGRTW")).replace("M", self.r.choice("ABCD")).replace("X", self.r.choice("CKPX"))

    def address(self) -> str:
        r = self.r
        n = str(r.randint(1, 9999) if r.random() < 0.1 else r.randint(1, 250)) + r.choice(["", "", "", "a", "b"])
        w = self.part()
        x = r.random()
        if x < 0.5:
            pre = r.choice(["", "", "", "Old ", "Upper ", "North ", "Lower "])
            return f"{n} {pre}{w} {r.choice(['Street', 'St', 'Road', 'Rd', 'Avenue', 'Ave', 'Lane', 'Close', 'Court', 'Drive', 'Terrace', 'Quay'])}"
        if x < 0.7:
            n = n.rstrip("ab") + r.choice(["", "", " bis"])
            street = r.choice(["rue de la {}", "avenue du {}", "boulevard des {}", "impasse du {}", "chemin des {}", "place de la {}", "rue {}"]).format(r.choice([w, f"{w} {self.part()}"]))
            return f"{n}{r.choice([' ', ', '])}{street}"
        if x < 0.85:
            street = r.choice(["Calle de los {}", "C/ {}", "C/ {} {}", "Avenida del {}", "Plaza del {}", "Rua das {}", "Travessa do {}"]).format(w, self.part())
            return f"{street}{r.choice([' ', ', '])}{n.rstrip('ab')}"
        street = r.choice(["", "", "Alte ", "Neue ", "Kleine "]) + r.choice([w + "straße", w + "strasse", w + "str.", w + "weg", w + "gasse", w + "platz", w + "ring", w + "allee"]) if r.random() < 0.8 else r.choice([f"Am Alten {w}", f"An der {w}"])
        return f"{street} {n}"

    def place(self) -> str:
        r = self.r
        t = r.choice(TOWNS)
        return r.choice([t, t, f"{r.randint(10000, 99999)} {t}", f"{t} TW{r.randint(1, 9)} {r.randint(1, 9)}QX"])

    def japanese(self) -> str:
        r = self.r
        a = "".join(r.choice(KANJI) for _ in range(r.choice((2, 2, 3))))
        b = "".join(r.choice(KANA) for _ in range(r.choice((2, 3, 3)))) if r.random() < 0.85 else "".join(r.choice(KANJI) for _ in range(2))
        return a + r.choice([" ", " ", ""]) + b

    def filler(self, slot: str) -> str:
        r = self.r
        d = lambda n: "".join(str(r.randint(1 if i == 0 else 0, 9)) for i in range(n))
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        ver = lambda: f"{r.randint(0, 24)}.{r.randint(0, 40)}.{r.randint(0, 40)}"
        rnd = "".join(r.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(12))
        made = {
            "w": lambda: r.choice(NOUNS), "W": lambda: r.choice(NOUNS).capitalize(), "two": lambda: r.choice(TWO_WORDS), "town": lambda: r.choice(TOWNS), "place": self.place, "ver": ver, "num": lambda: str(r.randint(1, 9999)),
            "login": lambda: r.choice(LOGINS), "log": lambda: r.choice(LOGINS) + str(r.randint(1, 99)), "bot": lambda: f"{r.choice(NOUNS)}-{r.choice(['bot', 'runner', 'agent', r.choice(NOUNS)])}", "title": lambda: r.choice(["Dr.", "Frau", "Herr", "Mr.", "Ms.", "Prof.", "Mrs.", "Sra."]), "trailer": lambda: r.choice(["Signed-off-by", "Reviewed-by", "Tested-by", "Acked-by", "Reported-by", "Co-authored-by", "Cc", "CC", "Bcc", "Suggested-by", "Helped-by"]),
            "date": lambda: f"2015-0{r.randint(1, 9)}-{r.randint(10, 28)}", "tick": lambda: f"{d(r.choice((3, 4)))}-{d(r.choice((2, 3)))}", "bld": lambda: f"{d(r.choice((4, 5)))}.{d(r.choice((2, 3, 4)))}", "b3": lambda: f"{d(r.choice((3, 4)))}.{d(r.choice((2, 3)))}.{d(r.choice((2, 3)))}",
            "pre": lambda: r.choice(["", "", "", "FYI: ", "Note: ", "NB: ", "WIP: ", "so ", "- "]), "year": lambda: str(r.randint(1996, 2030)), "wd": lambda: r.choice(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]), "mon": lambda: r.choice(["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]),
            "time": lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", "sha40": lambda: hexa(40), "h7": lambda: hexa(7),
            "verb": lambda: r.choice(["broke", "built", "checked", "found", "likes", "made", "saw", "tried", "uses", "wants", "will fix", "has to test", "can explain", "signed off", "is against", "told us about", "agreed to"]),
            "b85": lambda: "".join(r.choice(B85) for _ in range(r.randint(30, 66))),
            "ts": lambda: r.choice([d(10), d(10) + "." + d(3), d(10) + "000"]), "ord": lambda: f"{d(r.choice((3, 4)))}-{d(r.choice((2, 3)))}-{d(r.choice((5, 6, 7)))}", "uuid": lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", "hex": lambda: hexa(r.choice((8, 12))), "sha": lambda: r.choice([hexa(8), hexa(40), d(8), d(7), hexa(12)]), "rnd": lambda: rnd,
        }
        if slot in made:
            return made[slot]()
        return d(int(slot[1:]))  # d1, d2, ...

    def line(self) -> tuple[str, list[tuple[int, int, str]], Gazetteer]:
        r = self.r
        form = r.choice(self.positive) if r.random() < 0.6 else r.choice(self.negative)
        given, family = {"rose", "grace", "mark", "frank", "will", "dawn", "iris", "victor", "miles", "hana"}, {"winter", "street"}
        # texts of a message are plain or indented, changed lines carry a mark
        text, labels, i = r.choice(["", "    "] if form[:3] == "{P}" or form[:4] in ("diff", "inde", "--- ", "+++ ", "@@ -") else ["", "", "", "    ", "+", "-", " ", "+  ", "-    ", " \t"]), [], 0
        while i < len(form):
            c = form[i]
            if c in "{}" and form[i : i + 2] == c * 2:
                text, i = text + c, i + 2
            elif c == "{":
                end = form.index("}", i)
                slot, i = form[i + 1 : end], end + 1
                kind = {"N": "name", "G": "name", "C": "name", "J": "name", "E": "email", "P": "phone", "I": "identity", "A": "address"}.get(slot)
                if slot == "N":
                    s, g, f = self.name()
                    given |= {x.casefold() for x in g if r.random() < 0.55}
                    family |= {x.casefold() for x in f if r.random() < 0.45}
                elif slot == "G":  # one name alone counts where it is listed
                    s = r.choice(["Rose", "Grace", "Mark", "Frank", "Iris", "Victor", "Miles", "Paige", "Hana"])
                elif slot == "C":
                    s = r.choice(CYR[0]) + " " + r.choice(CYR[1])
                else:
                    s = {"J": self.japanese, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address}.get(slot, lambda: self.filler(slot))()
                if kind:
                    labels.append((len(text), len(text) + len(s), kind))
                text += s
            else:
                text, i = text + c, i + 1
        return text, labels, Gazetteer(given, family)


def _lse(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values)) if m > -math.inf else m


def gradient(w: dict[str, float], cands: list, gold: set[tuple[int, int, str]]) -> tuple[float, dict[str, float]]:
    """Log-likelihood of the labelled spans and its gradient, by forward and backward sums."""
    scores = [sum(w.get(f, 0.0) for f in fs) for *_, fs in cands]
    states = ["", *KINDS]
    starts, ends = defaultdict(list), defaultdict(list)
    for n, (a, b, k, _) in enumerate(cands):
        starts[a].append(n)
        ends[b].append(n)
    points = sorted({0, *starts, *ends})
    trans = lambda a, b: w.get(f"trans:{a}>{b}", 0.0)
    ninf = -math.inf
    fwd: dict[int, dict[str, float]] = {}
    prev = None
    for p in points:
        here = dict(fwd[prev]) if prev is not None else {s: (0.0 if s == "" else ninf) for s in states}
        for n in ends[p]:
            a, _, k, _ = cands[n]
            here[k] = _lse([here[k], *[fwd[a][s] + trans(s, k) + scores[n] for s in states if fwd[a][s] > ninf]])
        fwd[p] = here
        prev = p
    total = _lse(list(fwd[points[-1]].values()))
    bwd: dict[int, dict[str, float]] = {}
    nxt = None
    for p in reversed(points):
        here = dict(bwd[nxt]) if nxt is not None else dict.fromkeys(states, 0.0)
        for s in states:
            for n in starts[p]:
                _, b, k, _ = cands[n]
                here[s] = _lse([here[s], trans(s, k) + scores[n] + bwd[b][k]])
        bwd[p] = here
        nxt = p
    grad: dict[str, float] = defaultdict(float)
    for n, (a, b, k, fs) in enumerate(cands):
        for s in states:
            if fwd[a][s] > ninf:
                pr = math.exp(fwd[a][s] + trans(s, k) + scores[n] + bwd[b][k] - total)
                if pr > 1e-6:
                    grad[f"trans:{s}>{k}"] -= pr
                    for f in fs:
                        grad[f] -= pr
    ll, last = 0.0, ""
    by = {(a, b, k): n for n, (a, b, k, _) in enumerate(cands)}
    for g in sorted(gold):
        n = by[g]
        ll += scores[n] + trans(last, g[2])
        grad[f"trans:{last}>{g[2]}"] += 1
        for f in cands[n][3]:
            grad[f] += 1
        last = g[2]
    return ll - total, grad


#: Features that name the words around a span one by one.
LITERAL = ("head", "l1", "l2", "l3", "lw", "lr", "r1", "r2", "rw", "lb", "w0", "wn")


def train(n_lines: int = 24000, epochs: int = 8, hide: float = 0.3, seed: int = 5, rate: float = 0.25, l2: float = 2e-4, least: int = 2, verbose: bool = True) -> Model:
    maker = Maker(seed)
    data, missed, seen = [], defaultdict(int), defaultdict(int)
    for _ in range(n_lines):
        text, labels, gaz = maker.line()
        cands = candidates(text, gaz)
        have = {c[:3] for c in cands}
        for g in labels:
            if g not in have:
                missed[g[2]] += 1
                if verbose and missed[g[2]] <= 6:
                    print("no candidate:", g[2], repr(text[g[0] : g[1]]), "|", text, file=sys.stderr)
        if all(g in have for g in labels) and cands:
            data.append((cands, set(labels)))
            for *_, fs in cands:
                for f in fs:
                    seen[f] += 1
    data = [([(a, b, k, [f for f in fs if seen[f] >= least]) for a, b, k, fs in cands], gold) for cands, gold in data]
    w: dict[str, float] = defaultdict(float)
    g2: dict[str, float] = defaultdict(float)
    order = random.Random(seed)
    for e in range(epochs):
        order.shuffle(data)
        ll = 0.0
        for cands, gold in data:
            # contexts seen word for word are hidden at random, so that spans of unseen forms are found by the rest
            hidden = tuple(t for t in LITERAL if order.random() < hide)
            shown = [(a, b, k, [f for f in fs if f.split(":", 1)[1].split("=")[0] not in hidden]) for a, b, k, fs in cands] if hidden else cands
            one, grad = gradient(w, shown, gold)
            ll += one
            for f, g in grad.items():
                g -= l2 * w[f]
                g2[f] += g * g
                w[f] += rate * g / (math.sqrt(g2[f]) + 1e-6)
        if verbose:
            print(f"epoch {e}: mean log-likelihood {ll / max(1, len(data)):.4f}, {len(data)} lines, missed {dict(missed)}", file=sys.stderr)
    return Model({f: round(v, 4) for f, v in sorted(w.items()) if abs(v) >= 0.02})


def held_out(model: Model, n_lines: int = 1500, seed: int = 77, held: bool = True) -> dict[str, tuple[float, float]]:
    """Precision and recall per kind on lines of forms never trained on, by the path that ``find`` and ``redact`` take.

    With ``held`` False on other lines of the trained forms.
    """
    maker = Maker(seed, held)
    hit, said, true = defaultdict(int), defaultdict(int), defaultdict(int)
    for _ in range(n_lines):
        text, labels, gaz = maker.line()
        got = set(spans_of(text, decoder(model, gaz)))
        for x in got:
            said[x[2]] += 1
            hit[x[2]] += x in set(labels)
        for x in labels:
            true[x[2]] += 1
    return {k: (round(hit[k] / max(1, said[k]), 4), round(hit[k] / max(1, true[k]), 4)) for k in KINDS}


if __name__ == "__main__":
    fitted = train()
    print("forms trained on:", held_out(fitted, held=False), "forms held out:", held_out(fitted), len(fitted.w), "weights")
    with open(WEIGHTS, "w", encoding="utf-8") as f:
        json.dump(fitted.w, f, ensure_ascii=False, indent=0)
