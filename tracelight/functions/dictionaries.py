"""Word lists of the triage operators.

Fixed values: the terms must equal those that analysts' existing reports are based on.
"""

from __future__ import annotations

SUSPICIOUS = (
    "drip", "bypass", "cheat", "cheatengine", "keyauth", "vape", "crack", "celestial", "melonity", "celka", "akrien", "minced", "bushroot", "hitbox", "exloader", "clickcrystal",
    "autoclicker", "autoclick", "macro", "macros", "loader", "injector", "dllinject", "aimassist", "aimassistance", "killaura", "autoattack", "wurst", "konas", "rusherhack", "zamorozka",
    "novoline", "tenacity", "dortware", "inertia", "phobos", "thunderhack", "bleachhack", "sallos", "cyanit", "lyvell", "xerxes", "instavape", "placebo", "gclient", "omicron", "xetha",
    "conceal", "pandora", "rebellion", "nursultan", "catlean", "catlavan", "wexside", "arbuz", "zenith", "rockstar", "nurik",
)
CHEAT_ARTIFACTS = (
    "cheatengine", "cheat engine", "keyauth", "xenos", "extreme injector", "gh injector", "kdmapper", "kdu", "hwidspoofer", "hwid spoofer", "silentaim", "killaura", "aimassist",
    "autoclicker", "wallhack", "aimbot", "esp", "bhop", "norecoil", "no recoil", "mapper", "dsefix", "iqvw64e", "mhyprot", "dbutil_2_3", "gdrv", "rtcore64", "capcom.sys", "asusgio",
    "winring0", "eac bypass", "battleye bypass", "vgk bypass", "vanguard bypass", "nursultan", "celestial", "celka", "minced", "exloader", "macros", "catlean", "catlavan", "thunderhack",
    "bleachhack", "wexside", "arbuz", "zenith", "rockstar", "melonity", "nurik",
)
BYPASS_ARTIFACTS = (
    "sdelete", "bleachbit", "ccleaner", "timestomp", "set-mace", "setmace", "exiftool", "openstego", "steghide", "imdisk", "rubber ducky", "duckyscript", "ducky script",
    "auditpol /clear", "wevtutil cl", "vssadmin delete shadows", "fsutil usn deletejournal", "clear-recyclebin", "streams.exe", "dnscat", "iodine", "veracrypt", "truecrypt",
    "bcdedit /set testsigning on", "bcdedit /set nointegritychecks on", "Fsutil usn delete journal",
)
SUSPICIOUS_LINKS = (
    "drip", "cheatengine", "keyauth", "vape", "celestial", "melonity", "akrien", "minced", "exloader", "clickcrystal", "autoclicker", "dllinject", "aimassist", "killaura", "autoattack",
    "wurst", "rusherhack", "novoline", "tenacity", "dortware", "inertia", "phobos", "thunderhack", "bleachhack", "sallos", "cyanit", "lyvell", "xerxes", "instavape", "xetha", "spoofer",
    "kdmapper", "xenos", "timestomp", "sdelete", "bleachbit", "nursultan", "celka", "macros", "catlean", "catlavan", "wexside", "arbuz", "zenith", "rockstar", "nurik",
)
SUSPICIOUS_HOSTS = ("keyauth.win", "unknowncheats.me", "yougame.biz", "elitepvpers.com", "guidedhacking.com", "mpgh.net", "x64.gg", "cheater.fun", "celka.xyz", "nursultan.fun")
VULNERABLE_DRIVERS = ("iqvw64e.sys", "rtcore64.sys", "gdrv.sys", "capcom.sys", "asusgio.sys", "winring0x64.sys", "winring0.sys", "dbutil_2_3.sys", "mhyprot2.sys", "eneio64.sys")
REMOTE_ACCESS = (
    "anydesk", "teamviewer", "rustdesk", "parsec", "splashtop", "screenconnect", "connectwisecontrol", "supremo", "remoteutilities", "getscreen", "ultraviewer", "hoptodesk",
    "zohoassist", "ultravnc", "tightvnc", "realvnc", "aeroadmin", "ammyy", "radmin", "dwservice", "dwagent", "remoting_host", "quickassist", "nomachine", "gotomypc", "gotoassist",
    "logmein", "logmeinrescue", "remotepc", "islonline", "bomgar", "beyondtrust", "simplehelp", "rescueassist",
)
REMOTE_ACCESS_HOSTS = (
    "anydesk.com", "teamviewer.com", "rustdesk.com", "parsec.app", "splashtop.com", "dwservice.net", "screenconnect.com", "getscreen.me", "remotedesktop.google.com",
    "remoteassistance.support.services.microsoft.com", "nomachine.com", "gotomypc.com", "gotoassist.com", "logmein.com", "logmeinrescue.com", "remotepc.com", "islonline.com",
    "bomgar.com", "beyondtrust.com", "simple-help.com", "rescueassist.com",
)
REMOTE_SESSIONS = (
    "anydesk", "teamviewer", "rustdesk", "parsec", "splashtop", "screenconnect", "connectwisecontrol", "supremo", "remoteutilities", "getscreen", "ultraviewer", "ultravnc",
    "tightvnc", "realvnc", "aeroadmin", "ammyy", "radmin", "dwagent", "dwservice", "quickassist", "quick assist", "remoteassistance", "remotedesktop.google.com", "remoting_host",
    "chrome remote desktop", "mstsc", "msra", "rdpclip", "nomachine", "gotomypc", "gotoassist", "logmein", "logmeinrescue", "remotepc", "islonline", "bomgar", "beyondtrust",
    "simplehelp", "rescueassist",
)
TUNNELS = ("ngrok", "cloudflared", "trycloudflare", "chisel", "frpc", "frps", "localxpose", "playit", "pinggy", "tailscale", "zerotier", "wireguard", "hamachi", "wstunnel")
TUNNEL_HOSTS = ("ngrok.io", "ngrok-free.app", "ngrok.app", "trycloudflare.com", "localxpose.io", "playit.gg", "pinggy.io", "tailscale.com", "zerotier.com")
SEARCH_HOSTS = (
    "yandex.ru", "ya.ru", "google.com", "bing.com", "duckduckgo.com", "yahoo.com", "rambler.ru", "translate.yandex.ru", "favicon.yandex.net", "googletagmanager.com", "vk.com", "youtube.com",
)
CODE_HOSTS = ("github.com", "www.github.com", "gitlab.com", "www.gitlab.com", "bitbucket.org", "www.bitbucket.org", "sourceforge.net", "www.sourceforge.net")
CACHE_PATHS = (
    "\\service worker\\cachestorage\\", "\\service worker\\scriptcache\\", "\\code cache\\", "\\gpucache\\", "\\cache\\cache_data\\", "\\cache\\cache2\\entries\\", "\\webcache\\",
    "\\shadercache\\", "\\localstate\\appiconcache\\", "\\node_modules\\", "\\temp\\scoped_dir",
)
FALSE_POSITIVE_NAMES = ("triggerbot.exe", "triggerbot64.exe", "doomsday.exe", "doomsday64.exe")
COMMAND_WORDS = (
    "cmd", "reg", "hkey", "delete", "type", "echo", "forfiles", "wmic", "regsvr32", "rundll32", "powershell", "invoke-expression", "encodedcommand", "iex", "iwr", "http", "github",
    "pastebin", "base64", "invoke", "download",
)
LOG_NOISE = ("+j(cm:", "pgrf:", "usbxhci", "rtlstringcchcopyw failed", "od8_", "smctablemanager", "fb memory copy failed", "frame buffer memory copy failed")
SHELL_LAUNCHERS = (
    "cmd", "powershell", "pwsh", "wmic", "reg", "rundll32", "regsvr32", "mshta", "wscript", "cscript", "forfiles", "java", "javaw", "schtasks", "bitsadmin", "certutil", "wevtutil",
    "vssadmin", "wbadmin", "bcdedit", "fsutil", "cipher", "sdelete", "auditpol", "esentutl",
)
ACTION_WORDS = (
    "wevtutil", "clear-eventlog", "remove-eventlog", "vssadmin", "wbadmin", "bcdedit", "fsutil", "cipher", "sdelete", "auditpol", "clear-recyclebin", "del", "erase", "remove-item",
    "echo", "timestomp", "set-mace", "setmace", "exiftool", "touch", "streams", "eventcreate", "mimikatz", "sekurlsa", "lsadump", "procdump", "nanodump", "dumpert", "dkom", "eprocess",
    "kpcr", "bootkit", "rootkit", "volatility", "kdmapper", "kdu", "xenos",
)
TRIGGERS = (
    "cmd", "pwsh", "powershell", "schtasks", "bitsadmin", "certutil", "mshta", "wscript", "cscript", "reg", "delete", "add", "query", "create", "hkey", "type", "echo", "copy", "iex",
    "iwr", "irm", "invoke-expression", "invoke-webrequest", "invoke-restmethod", "-uri", "downloadstring", "downloadfile", "frombase64string", "encodedcommand", "-enc", ".ps1", ".bat",
    ".cmd", "processstart,", "!!", "http://", "https://", "ftp://", "url protocol", "hkey_classes_root", "hkcr", "shell\\open\\command", "%1", "base64", "regsvr32", "rundll32", "wmic",
    "java -jar",
)
INJECTION_CALLS = (
    "createremotethread", "createremotethreadex", "writeprocessmemory", "virtualallocex", "ntcreatethreadex", "queueuserapc", "setwindowshookex", "manualmap", "reflectivedll", "injectdll",
    "dllinject", "loadlibrarya", "loadlibraryw",
)
STREAM_EXTENSIONS = ("txt", "log", "dat", "bin", "jpg", "jpeg", "png", "wav", "mp3", "pdf", "doc", "docx", "xls", "xlsx", "exe", "dll", "sys", "bat", "cmd", "ps1")
SCRIPT_EXTENSIONS = (".com", ".exe", ".bat", ".cmd", ".vbs", ".vbe", ".js", ".jse", ".wsf", ".wsh", ".msc")
TRACKED_EXTENSIONS = (".exe", ".dll", ".jar", ".bat", ".cmd", ".ps1", ".pf")
LINK_SUFFIXES = (".com", ".net", ".org", ".ru", ".gg", ".io", ".me", ".xyz", ".top", ".site", ".store", ".cc", ".co", ".su", ".pw")
BUILD_PATHS = (
    "\\target\\debug\\", "\\target\\release\\", "\\target\\", "\\.fingerprint\\", "\\deps\\", "\\build\\", "\\.cargo\\registry\\", "\\.cargo\\git\\", "\\rustup\\toolchains\\",
    "\\windows kits\\", "\\microsoft visual studio\\", "\\source\\repos\\", "\\node_modules\\",
)
#: Public suffixes that links may end in; a larger table can be given.
PUBLIC_SUFFIXES = ("com", "net", "org", "ru", "gg", "io", "me", "xyz", "win", "fun", "biz", "app", "top", "site", "store", "cc", "co", "su", "pw", "dev", "info")

DICTIONARIES = {
    "suspicious": SUSPICIOUS, "cheat_artifacts": CHEAT_ARTIFACTS, "bypass_artifacts": BYPASS_ARTIFACTS, "suspicious_links": SUSPICIOUS_LINKS, "suspicious_hosts": SUSPICIOUS_HOSTS,
    "vulnerable_drivers": VULNERABLE_DRIVERS, "remote_access": REMOTE_ACCESS, "remote_access_hosts": REMOTE_ACCESS_HOSTS, "remote_sessions": REMOTE_SESSIONS, "tunnels": TUNNELS,
    "tunnel_hosts": TUNNEL_HOSTS, "search_hosts": SEARCH_HOSTS, "code_hosts": CODE_HOSTS, "public_suffixes": PUBLIC_SUFFIXES,
}

#: Marker lists of the memory-dump classifiers.
OPEN_MARKERS = ("\\device\\", "\\??\\", "\\pipe\\", "socket", "handle", "opensavepidlmru", "lastvisitedpidlmru", "typedpaths", "wordwheelquery", "runmru", "thumbcache", "iconcache", "windows.edb")
COMMAND_MARKERS = (
    "cmd.exe", "powershell", "pwsh", "conhost", "history", "stdin", "stdout", "stderr", "wevtutil", "reg add", "reg delete", "wmic", "schtasks", "vssadmin", "fsutil", "auditpol", "bcdedit",
)
COMMAND_ACTIONS = (
    " add ", " delete ", " query ", " create ", " config ", " start ", " stop ", " /c ", " -enc", " encodedcommand", " clear ", " remove ", " set ", " export ", " import ",
)
HIDDEN_PROCESS = ("hidden process", "ghost process", "orphan process", "terminated process", "process exited", "activeprocesslinks", "eprocess", "hollow")
SUSPICIOUS_NETWORK = ("beacon", "reverse shell", "meterpreter", "ngrok", "cloudflared", "discord.com/api/webhooks", "discordapp.com/api/webhooks", "pastebin", "webhook")
LOLBINS = ("mshta", "rundll32", "regsvr32", "powershell -enc", "powershell -encodedcommand", "pwsh -enc", "wmic process call create", "cmd.exe /c")
LOLBIN_NETWORK = (
    "http://", "https://", "wss://", "ws://", "invoke-webrequest", "invoke-restmethod", "downloadstring", "downloadfile", "curl ", "wget ", "socket", "connect", "outbound", "proxy",
)
PROTECTION_CHANGES = ("rwx", "execute_readwrite", "page_execute_readwrite", "virtualprotect", "virtualprotectex", "ntprotectvirtualmemory")
INJECTION_STEPS = (
    "writeprocessmemory", "createremotethread", "ntcreatethreadex", "queueuserapc", "virtualalloc", "ntmapviewofsection", "manualmap", "shellcode", "thread hijack", "process hollowing",
    "hollow",
)
JAVA_INJECTION = (
    "writeprocessmemory", "createremotethread", "ntcreatethreadex", "queueuserapc", "virtualalloc", "virtualprotect", "ntmapviewofsection", "manualmap", "process hollowing",
    "thread hijack", "setwindowshookex", "setthreadcontext", "resume thread", "shellcode",
)
DLL_KEYS = ("appinit_dlls", "knowndlls", "silentprocessexit", "ifeo", "__eventfilter", "commandlineeventconsumer")
MEMORY_CHANGES = ("inline hook", "trampoline", "detour", "patched", "patch", "checksum mismatch", "code cave", "modified memory", "guard page", "nop nop", "jmp ")
TRUSTED_DLL_DIRS = ("\\windows\\system32\\", "\\windows\\syswow64\\", "\\windows\\winsxs\\", "\\program files\\", "\\program files (x86)\\")
RISKY_DLL_DIRS = ("\\temp\\", "\\users\\public\\", "\\recycle.bin\\", "\\windows\\tasks\\")
RISKY_DLL_NAMES = ("inject", "manualmap", "hollow", "hook", "spoof", "bypass", "cheat", "mapper", "xenos", "kdmapper", "processhacker")
BENIGN_DRIVERS = ("winpmem", "dumpit", "av", "defender")
BENIGN_DLL_NAMES = (
    "microsoft.codeanalysis.", "discordhook.dll", "discordhook64.dll", "discord_overlay_sdk_", "msvcp140.dll", "msvcp140_codecvt_ids.dll", "vcruntime140.dll", "vcruntime140_1.dll",
    "ucrtbase.dll", "libcrypto-1_1.dll", "libssl-1_1.dll", "libffi-7.dll", "python38.dll", "python39.dll", "python310.dll", "python311.dll", "python312.dll", "python313.dll",
    "binary2strings.cp",
)
KNOWN_DLLS = (
    "\\knowndlls\\ntdll.dll", "\\knowndlls\\kernel32.dll", "\\knowndlls\\kernelbase.dll", "\\knowndlls\\user32.dll", "\\knowndlls\\gdi32.dll", "\\knowndlls\\advapi32.dll",
    "\\knowndlls\\ucrtbase.dll", "\\knowndlls\\sechost.dll",
)
NETWORK_CONTEXT = ("tcp", "udp", "socket", "connect", "listen", "accept", "bind", "send", "recv", "proxy", "rdp", "websocket", "ws://", "wss://", "netstat")
DOWNLOAD_COMMANDS = (
    "download?key=", "invoke-webrequest", "invoke-restmethod", "powershell -enc", "powershell -encodedcommand", "downloadstring", "downloadfile", " -outfile ",
)
TRUSTED_HOSTS = (
    "microsoft.com", "windowsupdate.com", "github.com", "githubusercontent.com", "githubassets.com", "chatgpt.com", "openai.com", "youtube.com", "google.com", "googleusercontent.com",
    "gstatic.com", "cloudflare.com", "mozilla.org", "yandex.ru", "yandex.com", "yandex.net", "vk.com", "discord.com", "discord.gg", "discordapp.com", "steamcommunity.com",
    "steampowered.com", "cdn.discordapp.com",
)
TRACE_NOISE = (
    '"type":"commandexecution"', '"type":"reasoning"', '\\"type\\":\\"commandexecution\\"', '\\"type\\":\\"reasoning\\"', '"tool_uses"', '"commandactions"', '"aggregatedoutput"',
    '"conversationid"', '"turn_trace_id"', '"request_id"', "diff --git", "@@ -", 'createelement("svg"', "<x:xmpmeta", "xmlns:rdf=", "<?xpacket", "\\u001b[",
)
PROXY_SETTINGS = ("proxyenable", "proxyserver", "autoconfigurl")
PROXY_TUNNELS = (
    "socks5", "socks4", "socks://", "tun2socks", "tun-in", "wintun", "sing-box", "v2ray", "xray", "clash", "nekoray", "proxifier", "proxychains",
)
LOCAL_ENDPOINTS = ("127.0.0.1:", "localhost:", "::1", "0.0.0.0:", "socks5://127.0.0.1", "http://127.0.0.1")
GAME_MARKERS = ("minecraft", ".minecraft", "javaw.exe", "lunarclient", "badlion", "feather", "meteorclient", "fabric-loader", "forge", "autoclicker", "killaura")
SUSPICIOUS_PORTS = (1337, 2222, 31337, 4444, 6666, 7777, 8081, 9001)
LOCAL_PROXY_PORTS = (1080, 10808, 10809, 2080, 2081, 3128, 7890, 7891, 9050, 9090)
EVENT_MARKERS = (
    "eventid=4624", "eventid=4625", "eventid=4648", "eventid=4634", "eventid=4688", "eventid=4672", "eventid=7045", "eventid=6005", "eventid=6006", "taskscheduler/operational",
    "security.evtx", "system.evtx",
)
GAME_CHEATS = (
    "liquidbounce", "meteorclient", "wurst", "impact client", "future client", "baritone", "forgehax", "javaagent", "authlib-injector", "clicker", "reach", "velocity", "autoclicker",
)
SEARCH_MARKERS = ("windows.edb", "searchindexer", "windows search", "search-ms")
THUMBNAIL_MARKERS = ("thumbcache", "iconcache", "thumbs.db")
PERSISTENCE_MARKERS = (
    "wmi event subscription", "__eventfilter", "__filtertoconsumerbinding", "commandlineeventconsumer", "ifeo", "silentprocessexit", "appinit_dlls", "knowndlls", "currentversion\\run",
    "currentversion\\runonce",
)
INJECTION_MARKERS = (
    "writeprocessmemory", "createremotethread", "ntcreatethreadex", "queueuserapc", "virtualalloc", "virtualprotect", "ntmapviewofsection", "manualmap", "shellcode", "rwx",
    "page_execute_readwrite", "thread hijack",
)
STRONG_OPEN_MARKERS = ("\\pipe\\", "socket", "opensavepidlmru", "lastvisitedpidlmru", "typedpaths", "wordwheelquery", "runmru", "thumbcache", "iconcache", "windows.edb")
OPEN_TOOLS = (
    "anydesk", "teamviewer", "rustdesk", "radmin", "parsec", "hoptodesk", "supremo", "wireguard", "tailscale", "zerotier", "cloudflared", "ngrok", "superfreevpn", "planetvpn",
    "happ\\tun\\sing-box", "cheat engine", "processhacker", "systeminformer", "autoclicker", "keyauth",
)
OPEN_NOISE_PATHS = (
    "\\.cargo\\registry\\", "\\.cargo\\git\\", "\\target\\debug\\", "\\target\\release\\", "\\target_release_check\\", "\\.fingerprint\\", "\\incremental\\", "\\toolchains\\",
    "\\share\\doc\\rust\\", "\\microsoft visual studio\\", "\\windows kits\\", "\\windowsapps\\", "thirdpartynotices.txt", "\\node_modules\\", "\\site-packages\\", "\\__pycache__\\",
    "\\msys64\\", "\\perl5\\", "\\service worker\\", "\\code cache\\", "\\cache_data\\",
)
DEVELOPER_TOOLS = (
    "\\program files\\git\\", "\\.cargo\\bin\\cargo.exe", "\\.cargo\\bin\\rustc.exe", "\\program files\\powershell\\7\\pwsh.exe", "\\vscode\\extensions\\",
    "\\program files\\microsoft visual studio\\", "\\program files (x86)\\microsoft visual studio\\",
)
ENVIRONMENT_NAMES = (
    "allusersprofile=", "appdata=", "localappdata=", "commonprogramfiles=", "commonprogramfiles(x86)=", "commonprogramw6432=", "comspec=", "systemroot=", "userprofile=", "windir=", "path=",
)
SENSITIVE_PLACES = ("\\appdata\\", "\\programdata\\", "\\users\\public\\", "\\recycle.bin\\", "\\windows\\tasks\\", "\\startup\\", "\\temp\\", "\\drivers\\")
TLS_MARKERS = ("https://", "tls", "ssl", "x509", "certificate", "encrypted")
MARKUP_NOISE = ('class="btn', 'target="_blank"', 'aria-label="toggle', 'id="themebtn"', 'id="pagestringsbtn"', 'id="pagedumpbtn"', "residence screenshare")
DIALOG_HISTORY = ("opensavepidlmru", "lastvisitedpidlmru")
USER_HISTORY = ("typedpaths", "wordwheelquery", "runmru")
