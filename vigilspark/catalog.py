"""Rules, keyword patterns and word lists as data.

Patterns have a short notation: ``@`` is a word boundary, ``~`` one or more blanks, ``%`` one or
more characters that aren't blanks. All ignore case. ``java`` and ``re2`` render them for Spark and
for the SQL oracle.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    bit: int
    level: int
    tactic: str
    name: str
    pattern: str


_RULES = """
1 Impact
    rm_rf                @rm~(?:-[rf]+~)*/
    rm_star              @rm~(?:-[rf]+~)*[*]
    kill_process         @kill~-9~
    dd_if                @dd~if=
    mkfs                 @mkfs@
    shutdown             @(?:halt|poweroff|reboot|shutdown)@
    init_0_6             @init~[06]@
1 Execution
    direct_execute       [.]/%
    bash_c               @bash~-c\\s
    sh_c                 @sh~-c\\s
    perl_e               @perl~-e\\s
    python_c             @python[23]?~-c\\s
    source_script        ^[.]~%|@source~%
    nohup                @nohup~
    eval                 @eval~
    dropper              chmod.*&&.*[.]/
1 Command and Control
    wget_execute         @wget~.*[|]\\s*(?:ba)?sh
    curl_execute         @curl~.*[|]\\s*(?:ba)?sh
    nc_shell             @(?:ncat|netcat|nc)~.*-e\\s
    bash_revshell        /dev/tcp/
    python_revshell      socket.*connect.*dup2
    perl_revshell        perl.*socket.*connect
    tftp_get             @tftp~
    wget_o               @wget~.*-O\\s
    curl_o               @curl~.*-o\\s
    base64_decode        @base64~(?:--decode|-d)
1 Resource Hijacking
    xmrig                @xmrig@
    stratum_proto        stratum[+]tcp://
    minerd               @minerd@
    cpuminer             @cpuminer@
    donate_level         --donate-level
    nicehash             @nicehash@
    cryptonight          @cryptonight@
1 Defense Evasion
    history_clear        @history~-[cdw]
    unset_hist           @unset~HIST
    histsize_0           HIST(?:FILE)?SIZE=0
    rm_logs              @rm~.*(?:[.](?:bash_)?history|/var/log/)
    truncate_logs        >\\s*/var/log/
    dev_null_redirect    2>/dev/null.*&>/dev/null
    systemctl_stop       @systemctl~stop@
    service_stop         @service~%~stop@
    ufw_disable          @ufw~disable@
    selinux_disable      @setenforce~0@
    iptables_flush       @iptables~-F@
2 Persistence
    crontab_edit         @crontab~-[el]
    etc_cron             /etc/cron
    rc_local             /etc/rc[.]local
    init_d               /etc/init[.]d/
    systemd_enable       @systemctl~enable
    bashrc_edit          >\\s*\\x7e?/?[.](?:profile|bash_profile|bashrc)
    authorized_keys      authorized_keys
2 Privilege Escalation
    sudo_command         @sudo~
    su_command           @su~-?(?:\\s*$|~\\w+)
    chmod_x              @chmod~(?:7|[+]?[0-7]*x)
    chmod_777            @chmod~777
    chown                @chown~
    setuid               @chmod~[24]
2 Credential Access
    etc_shadow           /etc/shadow
    etc_passwd_write     >>\\s*/etc/passwd
    passwd_command       @passwd~\\w+
    useradd              @useradd@
    adduser              @adduser@
    usermod              @usermod@
3 Discovery
    uname                @uname@
    cat_etc_passwd       @cat~/etc/passwd
    cat_etc              @cat~/etc/
    whoami               @whoami@
    id_command           @id@
    hostname             @hostname@
    ifconfig             @ifconfig@
    ip_addr              @ip~(?:addr|a)@
    netstat              @netstat@
    ss_command           @ss~-
    ps_aux               @ps~(?:ef|aux)
    w_command            (?:^|\\s|;)w(?:;|\\s|$)
    who_command          @who@
    last_command         @last@
    df_command           @df@
    free_command         @free@
    lscpu                @lscpu@
    nproc                @nproc@
    uptime               @uptime@
    ls_la                @ls~-la
    find_command         @find~/
    env_command          @(?:print)?env@
    dmesg                @dmesg@
    cat_cpuinfo          @cat~/proc/cpuinfo
    dmidecode            @dmidecode@
    virt_detect          @(?:systemd-detect-virt|virt-what)@
    docker_check         /proc/1/cgroup|[.]dockerenv
"""


def _rules() -> tuple[Rule, ...]:
    out, level, tactic = [], 0, ""
    for line in _RULES.strip("\n").replace("\\\\", "\\").split("\n"):
        if not line.startswith(" "):
            level, tactic = int(line[0]), line[2:]
        else:
            name, pattern = line.split(None, 1)
            out.append(Rule(len(out), level, tactic, name, pattern))
    return tuple(out)


RULES = _rules()
#: In order of precedence within their level.
TACTICS: tuple[str, ...] = tuple(dict.fromkeys(r.tactic for r in RULES))
LEVEL_OF: dict[str, int] = {r.tactic: r.level for r in RULES}

_SHORT = {"D": "Discovery", "P": "Persistence", "E": "Execution", "I": "Impact", "V": "Privilege Escalation", "C": "Command and Control", "A": "Credential Access", "R": "Resource Hijacking"}
#: Sets of tactics that together are a chain.
CHAINS: tuple[frozenset[str], ...] = tuple(frozenset(_SHORT[c] for c in word) for word in "DPE DPI DEI DVP CE CI AP CR ER".split())

#: Feature name -> pattern; counted is the number of commands that match.
KEYWORDS: dict[str, str] = {
    "F1_keyword_bash": "@bash@", "F2_keyword_shell": "@sh(?:ell)?@", "F3_keyword_exit": "@exit@", "F4_keyword_help": "@help@",
    "F5_keyword_passwd": "@passwd~\\w+", "F6_keyword_chpasswd": "@chpasswd@", "F7_keyword_useradd": "@useradd@",
    "F8_keyword_dot_file": "(?:^|;\\s*)[.]~%", "F9_keyword_sh_file": "@sh~(?:-c|%[.]sh)", "F10_keyword_slash_file": "(?:^|[;|]|&&)\\s*[.]/%",
    "F11_keyword_perl": "@perl~%", "F12_keyword_python": "@python[23]?~%", "F13_keyword_bin": "/bin/%", "F14_keyword_chmod": "@chmod@",
    "F15_keyword_sudo_su": "@sudo~(?:su@|-i@|bash@)", "F16_keyword_rm": "@rm~", "F17_keyword_history": "@history\\s*-[cdw]|HISTSIZE=0|@unset~HISTFILE",
    "F18_keyword_cat_etc": "@cat~/etc/", "F19_keyword_uname": "@uname@", "F20_keyword_wc": "@wc@", "F21_keyword_crontab": "@crontab@",
    "F22_keyword_w": "(?:^|\\s|;)w(?:;|\\s|$)", "F23_keyword_ps": "@ps@", "F24_keyword_free": "@free@", "F25_keyword_lscpu": "@lscpu@",
    "F26_keyword_nproc": "@nproc@", "F27_keyword_uptime": "@uptime@", "F28_keyword_wget": "@wget@", "F29_keyword_tftp": "@tftp@",
    "F30_keyword_scp": "@scp@", "F31_keyword_ping": "@ping@", "F32_keyword_kill": "@kill@",
    "F33_keyword_reboot": "@(?:shutdown@|reboot@|init~[06]@)", "F34_count_base64": "@base64@",
    "extra_keyword_curl": "@curl@", "extra_keyword_nc": "@(?:ncat|netcat|nc)@",
}
#: Feature name -> pattern; counted are all matches in all commands.
TOTALS: dict[str, str] = {"F35_count_hex": "(?:\\\\x[0-9a-f]{2}|0x[0-9a-f]+)", "F36_count_url": "(?:ftp|https?)://%"}

#: A decode pipeline, whose payload is read; a bare decode; escapes piped to a shell; an escape.
DECODE_PIPE = "@base64~(?:--decode|-d)~<<<|echo~[\"']?[a-z0-9+/=]+[\"']?\\s*[|].*@base64~(?:--decode|-d)"
DECODE_BARE = "@base64~(?:--decode|-d)"
ESCAPE_PIPE = "echo~-[ne]+~['\"].*\\\\x[0-9a-f]{2}.*['\"].*[|]\\s*(?:ba)?sh"
ESCAPE = "\\\\x[0-9a-f]{2}"

KNOWN_COMMANDS: tuple[str, ...] = tuple(sorted("""
    alias apt awk bash cat cd chgrp chmod chown cp crontab curl df dnf docker du echo export fdisk find free git grep gunzip gzip head
    history hostname htop ifconfig iptables kill less locate ls man mkdir more mount mv nano netstat nmap npm passwd perl ping pip ps
    python rm rmdir scp sed service sort source ss ssh su sudo systemctl tail tar top touch umount uname unzip vi vim wget which whoami yum zip
""".split()))  # fmt: skip

COMMON_PASSWORDS: tuple[str, ...] = tuple(sorted("""
    000000 111111 121212 123123 1234 12345 123456 12345678 123456789 1234567890 1q2w3e4r 1qaz2wsx 654321 666666 888888 abc123 access admin
    admin123 administrator alpine apache backup baseball centos changeme charlie debian default demo donald dragon fedora football ftp ftpuser
    guest harley hello iloveyou jenkins jordan23 letmein linux login manager master master123 michael monkey mysql nginx oracle p@ssw0rd
    p@ssword pass pass123 passw0rd password password1 password1! password123 pi postgres princess qazwsx qwerty qwerty123 raspberry redhat redis
    root server service setup shadow sunshine superuser support system temp test test123 tomcat toor trustno1 ubuntu user vagrant web welcome
    whatever www zaq12wsx
""".split()))  # fmt: skip

#: Substrings of an SSH client's version, the first that occurs counts, with the family and its code.
SSH_FAMILIES: tuple[tuple[str, str, int], ...] = tuple(
    (part, family or part, code)
    for code, (part, _, family) in enumerate((x.partition("=") for x in "openssh putty libssh dropbear paramiko asyncssh go=golang ruby nmap masscan".split()), 2)
)
SCANNERS = ("masscan", "nmap")


def java(pattern: str) -> str:
    """For Spark: Unicode classes, Unix lines, and the blanks that Java's class lacks."""
    blank = r"[\s\x1c-\x1f]"
    out = pattern.replace("\\s", blank).replace("~", blank + "+").replace("%", r"[^\s\x1c-\x1f]+").replace("@", r"\b")
    return "(?iUd)" + out


def re2(pattern: str) -> str:
    """For the SQL oracle, which reads it with its own flag for case."""
    return pattern.replace("~", r"\s+").replace("%", r"\S+").replace("@", r"\b")


def python(pattern: str) -> str:
    return re2(pattern)
