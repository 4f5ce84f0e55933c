from snapweave.sources import sites


def _p(spark, html, url="http://site.example/list?page=1"):
    return spark.createDataFrame([(1, url, f"<html><body>{html}</body></html>")], "pid int, url string, html string")


def test_lists(spark):
    cc = ('<div id="column_main"><table><tr class="row_featured"><td><a href="/job/1">a</a></td></tr>'
          '<tr class="header"><td><a href="/x">h</a></td></tr><tr class="row_odd"><td><a href="job/2">b</a></td></tr></table></div>')
    assert [r.job_url for r in sites.cc_list(_p(spark, cc), ["pid"]).orderBy("row_pos").collect()] == \
        ["http://site.example/job/1", "http://site.example/job/2"]
    st = ('<div class="main-content"><div class="template hits-tamplate"><b>Expires</b>: Dec 12, 2016 <br/>'
          '<p class="view-task"><a href="task.php?id=9">view</a></p></div></div>')
    r = sites.st_list(_p(spark, st), ["pid"]).collect()[0]
    assert (r.job_url, r.expire) == ("http://site.example/task.php?id=9", "Dec 12, 2016")
    mf = ('<div id="jobslist"><table><tr name="RUNNING"><td>1</td><td><a href="j?id=3">x</a></td>'
          + "<td>c</td>" * 9 + '<td>87.5%</td></tr><tr name="DONE"><td>2</td></tr></table></div>')
    r = sites.mf_list(_p(spark, mf), ["pid"]).collect()
    assert [(x.job_url, x.success_pct) for x in r] == [("http://site.example/j?id=3", 87.5)]
    jb = ('<div id="si-content"><table><tbody><tr><td>1</td><td><a href="/job/44">x</a></td><td>c</td><td>91</td></tr></tbody>'
          '<tfoot><tr><td>Page 1 of 7</td></tr></tfoot></table></div>')
    r = sites.jb_list(_p(spark, jb), ["pid"]).collect()[0]
    assert (r.job_url, r.success_pct) == ("http://www.jobboy.com/job/44", 91.0)
    assert sites.jb_page_count(_p(spark, jb), ["pid"]).collect()[0].n_pages == 7
    lm = ('<div id="jobslist"><table><tr name="RUNNING"><td>1</td><td><a href="/jd?Id=8">x</a></td><td>c</td><td> 66% </td></tr></table></div>')
    r = sites.legacy_mw_list(_p(spark, lm), ["pid"]).collect()[0]
    assert (r.job_url, r.success_pct_text) == ("http://site.example/jd?Id=8", "66%")


def test_job_pages(spark):
    cc = ('<div id="column_main"><h1>Review our book</h1><table><tr><td>'
          '<p>Workers from any of these countries</p><span>United States</span><h3>Job Description</h3>'
          '<p>Buy on amazon and write a review</p><h3>Required proof that job was finished</h3><p>link</p></td>'
          '<td><div><h3>Job Details</h3>Job ID: cc77 <span class="featured">F</span> Pay <b>0.40</b> of <b>30</b>'
          ' Available Positions <span>12</span> Success: 93.5 and 15 minutes to complete <a>Reviews</a></div>'
          '<div><h3>About the Employer</h3><b><a href="profile.php?id=e5">e</a></b></div></td></tr></table></div>')
    r = sites.cc_job(_p(spark, cc), ["pid"]).collect()[0]
    assert (r.name, r.id, r.featured, r.payment, r.work_total, r.work_done) == ("Review our book", "cc77", True, 0.4, 30, 18)
    assert (r.success_pct, r.duration, r.countries, r.cat, r.employer) == (93.5, 15, ["United States"], ["Reviews"], "e5")
    assert r.expected == ["Buy on amazon and write a review"] and r.proof == ["link"]
    jb = ('<div class="container"><div style="margin:1px; padding:2px"><h4>$0.50</h4><h4>10 min</h4><h4>3</h4><h4>40</h4></div></div>'
          '<div id="si-content"><h2>Amazon <b>task</b></h2><strong>Job Description</strong><p>Post a review on amazon</p></div>'
          '<div class="signup"><div style="margin:0; padding:0"><form action="/apply/991"></form></div></div>')
    r = sites.jb_job(_p(spark, jb), ["pid"]).collect()[0]
    assert (r.name, r.id, r.payment, r.duration, r.work_done, r.work_total) == ("Amazon task", "991", 0.5, 10, 3, 40)
    assert sites.jb_job(_p(spark, jb.replace("amazon", "shop")), ["pid"]).count() == 0
    mf = ('<table id="AutoNumber28"><tr><td><span>Rate the app</span><p>Job ID: mf1 done <b>4</b> of <b>50</b> pay <b>0.2</b> <b>6</b></p>'
          '<p><b>You can accept this job if you are from these countries</b></p><table><tr><td>USA, UK , India</td></tr></table>'
          '</td></tr></table>')
    r = sites.mf_job(_p(spark, mf), ["pid"]).collect()[0]
    assert (r.name, r.id, r.work_done, r.work_total, r.payment, r.duration) == ("Rate the app", "mf1", 4, 50, 0.2, 6)
    assert r.countries == ["USA", "UK", "India"]
    st = ('<div class="register-content"><div class="task-top"><b>Title</b> Like our page <b>Tasks Available</b>: 25 '
          '<b>Requester</b> acme <b>Reward</b> $0.05 <b>Duration</b> 3 min</div>'
          '<div class="box">a</div><div class="box">Do this</div><div class="divider"></div></div>')
    r = sites.st_job(_p(spark, st), ["pid"]).collect()[0]
    assert (r.name, r.work_remain, r.employer, r.payment, r.duration) == ("Like our page", 25, "acme", 0.05, 3)
    assert r.expected == ["Do this"]
    off = '<h3>Sorry! This task is currently not active</h3>' + st
    assert sites.st_job(_p(spark, off), ["pid"]).count() == 0
    lm = ('<table><tr><td><table><tr><td><table><tr><td width="520"><span>Old job</span><p><b>Cat</b> Sub</p>'
          '<table></table><table><tr><td><p>Job ID: 7x <b>1</b> <b>9</b> <b>0.1</b> <b>4</b></p><a href="u?Id=m9">e</a></td></tr></table>'
          '<table><tr><td><p>Canada</p></td></tr></table><table><tr><td><p>do it</p><p>-</p><p>proof</p></td></tr></table>'
          '</td></tr></table></td></tr></table></td></tr></table>')
    r = sites.legacy_mw_job(_p(spark, lm), ["pid"]).collect()[0]
    assert (r.name, r.id, r.work_done, r.work_total, r.payment, r.duration, r.employer) == ("Old job", "7x", 1, 9, 0.1, 4, "m9")
    assert (r.countries, r.category, r.sub_category, r.expected, r.proof) == (["Canada"], "Cat", "Sub", ["do it"], ["proof"])


def test_user_pages(spark):
    cc = ('<div id="column_main"><h2>ann</h2><div>ID: u77<br/>Country<br/> United States<br/>Member Since: May 3, 2014 <br/></div>'
          '<div class="profile_stats"><h3>Worker Statistics</h3><label>Jobs Complete</label> 12 <br/><label>Not Satisfied</label> 2 <br/>'
          '<label>Satisfied</label> 9 <br/><label>Average Job Price</label> $0.15 <br/><label>Total Earned</label> $1.80</div>'
          '<div class="profile_stats"><h3>Other Statistics</h3><label>Jobs Posted</label> 5</div></div>')
    r = sites.cc_user(_p(spark, cc), ["pid"]).collect()[0]
    assert (r.name, r.id, r.country, r.member_since) == ("ann", "u77", "United States", "May 3, 2014")
    assert (r.tasks_done, r.tasks_satisfied, r.tasks_not_satisfied, r.avg_per_task_earned, r.total_earned) == (12, 9, 2, 0.15, 1.8)
    assert (r.tasks_paid, r.avg_per_task_paid, r.total_paid) == (None, None, None)
    both = cc.replace("Other Statistics", "Employer Statistics")
    assert sites.cc_user(_p(spark, both), ["pid"]).collect()[0].tasks_paid == 5

    def table(number, *rows):
        return f'<table id="AutoNumber{number}">' + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>"
    mw = (table(64, ("Nickname", "<b>bob</b>"), ("ID", " m5 "), ("Member since", "2013-01-02"), ("Country", " United Kingdom "), ("City", "Leeds"))
          + table(91, ("<b>Total Earned</b>", "<b>$ 21.5</b>"), ("Tasks done", "300"))
          + table(92, ("<b>Basic tasks</b>", "<b>280</b>"), ("Not-Satisfied", "7"), ("Satisfied", "270"), ("Average per task", "0.07"))
          + table(93, ("<b>Hire Group</b>", "<b>20</b>"), ("Satisfied", "19"), ("Not-Satisfied", "1"), ("Average per task", "0.1"))
          + table(95, ("<b>Basic Campaigns</b>", "<b>3</b>"), ("Tasks paid", "90"), ("Total paid", " 9.5 "), ("<b>Hire Group</b>", "<b>1</b>"),
                  ("Tasks paid", "8"), ("Total paid", "n/a"), ("<b>Employer type</b>", "Starter level")))
    r = sites.legacy_mw_user(_p(spark, mw), ["pid"]).collect()[0]
    assert (r.name, r.id, r.member_since, r.country, r.city) == ("bob", "m5", "2013-01-02", "United Kingdom", "Leeds")
    assert (r.total_earned, r.tasks_done, r.basic_tasks, r.basic_satisfied, r.basic_not_satisfied, r.basic_avg_per_task) == (21.5, 300, 280, 270, 7, 0.07)
    assert (r.hg_tasks, r.hg_satisfied, r.hg_not_satisfied, r.hg_avg_per_task) == (20, 19, 1, 0.1)
    assert (r.basic_campaigns, r.basic_tasks_paid, r.hg_campaigns, r.hg_tasks_paid, r.employer_type) == (3, 90, 1, 8, "Starter level")
    assert (r.basic_total_paid, r.hg_total_paid) == (9.5, None)


def test_shorttask_pages_and_list_attributes(spark):
    row = ('<div class="template hits-tamplate"><b>Expires</b>: 5 days <p class="view-task"><a href="task.php?id=t9">see</a></p></div>')
    page = ('<div><div class="task-top"><a href="tasks.php?page=2">Next</a> <a href="tasks.php?page=14">Last</a></div></div>'
            f'<div class="main-content">{row}</div>')
    lists = _p(spark, page, "http://site.example/tasks.php")
    assert sites.st_page_count(lists, ["pid"]).collect()[0].n_pages == 14
    assert sites.st_page_count(_p(spark, "<p>none</p>"), ["pid"]).collect()[0].n_pages is None
    job = ('<div class="register-content"><div class="task-top"><b>Title</b> Like our page <b>Tasks Available</b>: 25 '
           '<b>Requester</b> acme <b>Reward</b> $0.05 <b>Duration</b> 3 min</div></div>')
    pages = _p(spark, job, "http://site.example/task.php?id=t9").union(_p(spark, job, "http://site.example/task.php?id=t8"))
    got = {r.url[-2:]: (r.job_id, r.expire, r.name) for r in sites.st_tasks(lists.union(lists), pages, ["pid"]).collect()}
    assert got == {"t9": ("t9", "5 days", "Like our page"), "t8": (None, None, "Like our page")}
