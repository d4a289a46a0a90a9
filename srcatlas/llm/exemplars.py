"""Labelled exemplars, fewer than 300 in all, that the residue models start from: notices, filler, lines with slots, and
ordinary lines with the same marks.

They are ordinary wordings of such texts in several languages, not taken from any table.
"""

from __future__ import annotations

NOTICES = [
    "404 Not Found", "Error 404 - page not found", "404 - The page you requested could not be found.", "This page could not be displayed.", "The link you followed may be broken, or the page may have been moved or deleted.",
    "403 Forbidden", "Access denied. You do not have permission to view this page.", "401 Unauthorized. Please log in to continue.", "400 Bad Request", "410 Gone. This page is no longer available.",
    "500 Internal Server Error", "Oops! Something went wrong on our side.", "An unexpected error has occurred. Please try again later.", "Our engineers have been notified about it.", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout: the server gave no answer in time.",
    "The server timed out after 30 s.", "Whoops, there was a problem loading the page.", "We could not load this page. Reload or try again in a few minutes.", "429 Too many requests. You have been rate limited.", "Your IP address has been blocked.",
    "Go to the home page or use the search.", "Back to start", "Back to top", "Home > Docs > Guides > Overview", "Skip to content Menu Search Sign in", "Contact the site team if this goes on.", "Request id 6c38956554e4", "Terms - Privacy - (c) 2024", "We use cookies to make this site better.",
    "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser. Turn it on and reload the page.", "This site requires JavaScript.", "This application needs scripts to run. Please allow scripts and cookies for this site, then try again.", "Your browser does not support scripts.", "JS is required.", "JS is disabled.", "You need to enable JavaScript to run this app.", "Without scripts this view stays empty.", "The content is only drawn on the client.", "A script blocker may be switched on.",
    "Please wait while the page is loading", "Loading...", "Just a moment...", "One moment please", "Checking your browser before accessing the site.", "Verify that you are human.", "Redirecting you to the login page", "Please wait, you will be redirected.", "Click here if nothing happens.", "Click here if you are not redirected.",
    "Please sign in to continue.", "Sign in again to continue reading.", "Log in to see this page.", "Your session has expired.", "You must be logged in to view this repository.", "Service under maintenance, we will be back at 14:00.", "Scheduled maintenance in progress. Please come back later.", "The site is down for maintenance.",
    '{"message":"Not Found","code":404}', '{"error":"rate limited","status":429}', '{"message":"Bad credentials","documentation_url":"https://docs.example.com"}', '{"error": "internal server error", "request_id": "77ab"}', '{"status": 403, "error": "access denied"}',
    "HTTP/1.1 404 not found\ncontent-length: 0\nx-request: 70f2af5c8d501965", "HTTP/1.1 503 service unavailable\nretry-after: 30", 'Traceback (most recent call last):\n  File "/srv/app/render.py", line 77, in render\n    return page.body', "TemplateError: 'title' is undefined", "KeyError: 'summary'",
    "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1><hr>nginx</body></html>", "<html><head><title>Error</title></head><body><h1>Service unavailable</h1></body></html>", "<noscript>Please enable JavaScript.</noscript>",
    "Seite nicht gefunden", "Die Seite wurde nicht gefunden.", "Zugriff verweigert.", "Interner Fehler", "Bitte melden Sie sich erneut an.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Wartungsarbeiten, bitte warten Sie.", "Der Dienst ist zurzeit nicht erreichbar.",
    "Page introuvable", "Page non trouvée.", "Accès refusé", "Erreur interne du serveur", "Veuillez vous reconnecter.", "Activez JavaScript pour afficher cette page.", "Maintenance en cours, veuillez patienter.", "Le service est temporairement indisponible.",
    "Página no encontrada", "Acceso denegado", "Error interno del servidor", "Inicie sesión de nuevo para continuar.", "Active JavaScript para ver esta página.", "Sitio en mantenimiento, espere por favor.", "El servicio no está disponible temporalmente.",
]

FILLERS = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "Lorem ipsum dolor sit amet consectetur adipisci elit sed do eiusmod tempor incidunt lorem ipsum turpis.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.", "This is placeholder text for the section. Write something here later.", "Placeholder copy goes here.", "Sample text goes here. Replace this paragraph with your own words.", "Text goes here. Content goes here. Description goes here.",
    "Dummy text, to be replaced. Your text here.", "Your name goes here. Your example goes here.", "blah blah blah blah blah blah", "foo bar baz foo bar baz foo bar baz", "foo bar foo bar foo bar", "test test test test test test", "xxx xxx xxx xxx xxx xxxx xxxx", "asdf asdf asdf jkl jkl asdf qwer qwer zxcv", "qwe rty qwerty asdfgh zxcvbn", "sdfkj skdjf lkjsdf wqer qwet zxvc bzxc", "aaa bbb ccc aaa bbb ccc", "text text text text text text", "word word word word word", "bla bla bla bla bla", "abc abc abc abc abc", "...... ...... ......", "1 2 3 test 1 2 3 test",
]

SLOTTED = [
    "Welcome to {{ service_name }}.", "# {{project}}", "Maintainer: {{ owner.name }}", "Hello {{first_name}},", "Welcome to {module_name}.", "This page belongs to {team}.", "Dear {first_name},", "Regards, {0}", "The owner of {module} is {1}.", "Release notes of ${MODULE_NAME}, written by ${OWNER}", "Contact ${team.name} for access.", "Made by #{author}.", "# {{cookiecutter.project_name}}",
    "# %MODULE%", "Regards, %DATE%", "Dear %NAME%,", "# #TITLE# for #OWNER#", "This package is looked after by #TEAM#.", "# [[TITLE]]", "Looked after by [[ summary ]].", "# @@NAME@@ by @@TEAM@@", "Maintainer: @@OWNER@@", "# __PACKAGE_NAME__", "Written by __AUTHOR__.", "Welcome to <%= name %>.", "Ask <%= owner %> about it.", "# <%= title %>", "{% title %} by {% author %}",
    "# <PROJECT_TITLE>", "Looked after by <CONTACT>.", "<add a short description>", "<insert the name of the project>", "Ask <your name> first.", "Written by <owner> on <date>.", "Call <phone number>.", "<describe what the module does>", "<link to the wiki>", "# <project name>",
    "Ask [insert date] about [Your team name].", "Dear [Name],", "Contact [email address] for help.", "[Company name] maintains it.", "[write a summary]", "[describe the change]", "[Describe the usage here]", "[Title]", "[date]", "[TODO]", "[PROJECT NAME]", "[link to the ticket]", "[owner]",
    "# (package name)", "Regards, (your name)", "Written by (author) for (company name).", "Ask (name of the owner).", "(short description)", "(insert date)",
    "Name: ______", "Signed ____ on ____.", "Due: ........", "Version X.Y.Z of YYYY-MM-DD", "Released on DD/MM/YYYY as vX.Y", "Owner: XXXX", "Price: ???", "Hello %s, you have %d new messages.", "Built %d of %s",
    "Hello undefined, your build of null finished in NaN ms.", "Last updated by [object Object] on Invalid Date", "Title: undefined", "Summary: null", "Owner: None", "Thanks, None", "Written by undefined at null.", "Changed by None on None.", "Posted by None.", "Sent by None at None.", "Dear null,", "Showing {{ count }} of {{ total }} results", "It took NaN s.", "Welcome, undefined!",
    "TODO: fill in this section", "TODO: describe the module", "TBD", "FIXME: write this part", "Insert text here.", "Your text here", "Add a description here", "To be written.", "TBD: add the summary", "Describe the project here.", "To be completed.",
]

ORDINARY = [
    "See the notes (see above) and the other list (see below).", "An argument (optional) and its value (default).", "It costs ten (approx) or so (more or less).", "Use a cache (for example) of pages (at most).", "Sizes (in bytes) and speeds (bytes per second).", "The last one (again), the first (now) and both (not yet).", "Read it (and only it) once (or twice).", "Tests (slow) and checks (fast) of the service (experimental).",
    "The array [first, second] is kept.", "A list [see below] of three [at least one] items.", "As told in [Smith, a year] and [sic] elsewhere.", "Press <enter> or <tab> to go on, <see below>.", "Paths like {first, last} and sets {one, two}.",
    "We compare None with null.", "The value is undefined until the first run.", "It returns null where nothing is found.", "A missing key gives None, not an error.", "Since NaN and undefined were mixed up, both are missing now.", "When the field was null it failed.", "Fixed a crash when the name is undefined.", "Rows with NaN are dropped.", "The change renamed undefined to absent.", "If it is None, the default is used.",
    "TODO list of the team: split the table and move the tests.", "A FIXME was left in the code on purpose.", "The placeholder XXX is a mark of the old editor.", "Does it work??? We think so...", "Wait..... then go on.",
]
