"""casewise.functions"""
